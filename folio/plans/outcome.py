"""What became of a page: one status of a closed set, decided in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a bot protection's reason says.
CHALLENGE = ("cloudflare", "challenge", "captcha", "are you human", "just a moment", "attention required", "ddos", "bot protection")
STATUSES = ("ok", "partial", "challenge", "auth_required", "blocked", "spa_shell", "empty_after_render")


def challenge(reason: Column) -> Column:
    return F.lower(reason).rlike("|".join(CHALLENGE))


def status(robots: Column, http: Column, reason: Column, blocked: Column, gate: Column, shell: Column, rendered: Column, fell_back: Column, blocks: Column) -> Column:
    none = blocks == 0
    return (
        F.when(robots, "blocked").when(http.isin(401, 407), "auth_required").when(challenge(reason), "challenge").when(http >= 400, "blocked").when(blocked, "blocked")
        .when(gate != "", "challenge").when(none & shell, "spa_shell").when(none, "empty_after_render").when(fell_back, "partial").otherwise("ok")
    )


def diagnosis(blocked: Column, non_lexical: Column, other_dropped: Column, latent: Column, nodes: Column) -> Column:
    """Why a page is empty."""
    return F.when(blocked, "blocked").when(non_lexical & ~other_dropped, "only non-lexical text").when(other_dropped, "all text was dropped").when(latent > 0, "only hidden text").when(nodes == 0, "no text nodes").otherwise("unknown")


def change(not_modified: Column, same_etag: Column, same_raw: Column, same_text: Column) -> Column:
    """The five rungs of change detection, cheapest first."""
    return F.when(not_modified, "not-modified").when(same_etag, "etag-match").when(same_raw, "raw-match").when(same_text, "text-match").otherwise("changed")


def shell(text_chars: Column, hydration: Column, script_bytes: Column, canvases: Column) -> Column:
    """Whether a served page is an empty shell: hardly a word, and something that would fill it."""
    return (text_chars < 100) & (hydration | (script_bytes > 0) | (canvases > 0))


def evidence(robots: Column, http: Column, reason: Column, blocked: Column, gate: Column, shell: Column, rendered: Column, fell_back: Column, tier_reason: Column, blocks: Column) -> Column:
    """The first thing that speaks for a page's status, null where it is ok."""
    none, answered = blocks == 0, F.concat(F.lit("the server answered HTTP "), http.cast("string"))
    return (
        F.when(robots, "robots.txt disallows this path for this user agent").when(http.isin(401, 407), answered).when(challenge(reason), reason).when(http >= 400, answered)
        .when(blocked, F.when(reason != "", reason).otherwise("the site refused this client")).when(gate != "", F.concat(F.lit('an entry screen labelled "'), gate, F.lit('" was not passed')))
        .when(none & shell & ~rendered, "the served document is a shell and no browser rendered it").when(none & shell, "the served document is a shell and rendering it produced no text")
        .when(none & rendered, "the page rendered and carried no extractable text").when(none, "no extractable text was found in the served document")
        .when(fell_back, F.when(tier_reason != "", tier_reason).otherwise("a higher tier was chosen and did not deliver, so a cheaper one was used"))
    )
