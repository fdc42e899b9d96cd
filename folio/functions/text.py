"""Text functions. Patterns are written so that Java and RE2 read them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space, direction marks, invisible characters and wide scripts that the results depend on.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BIDI = r"[\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"
INVISIBLE = r"[\x{ad}\x{200b}-\x{200d}\x{2060}-\x{2064}\x{feff}\x{fff9}-\x{fffb}\x{e0000}-\x{e007f}\x{e0100}-\x{e01ef}]"
STRIPPED = r"[\p{Cf}\x{fffd}\x{e0000}-\x{e007f}\x{e0100}-\x{e01ef}]"
WIDE = r"[\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{20000}-\x{2ebef}]"
HIDDEN_ELEMENTS = tuple(rf"(?is)<{t}[^>]*>.*?</{t}>" for t in ("script", "style", "noscript", "template"))
TAG = r"(?s)<[^>]+>"
TITLE = r"(?is)<title>(.*?)</title>"
STOP_WORDS = ("the", "and", "that", "this", "with", "from", "have", "has", "was", "were", "they", "their", "there", "which", "what", "when", "where", "page", "site", "about")
SHELL_MARKERS = ("you need to enable javascript", "enable javascript to run this app", "please enable javascript", "javascript is required", "this site requires javascript", "just a moment", "checking your browser", "verifying you are human", "enable cookies and reload", "access denied", "attention required")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(_c(c), F.lit(pattern))


def collapse(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(_c(c), SPACE + "+", " "))


def dedupe_key(c: Column | str) -> Column:
    return F.lower(collapse(c))


def clean(c: Column | str) -> Column:
    """Without direction marks, invisible and broken characters; white space collapsed."""
    return collapse(F.regexp_replace(_c(c), STRIPPED, ""))


def clean_report(c: Column | str) -> list[Column]:
    """text, removed, had_bidi, had_invisible."""
    c = _c(c)
    return [clean(c).alias("clean_text"), count_matches(c, STRIPPED).cast("long").alias("removed"), c.rlike(BIDI).alias("had_bidi"), c.rlike(INVISIBLE).alias("had_invisible")]


def truncate(c: Column | str, n: int) -> Column:
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.trim(F.substring(c, 1, n)), F.lit("…"))).otherwise(c)


def round_to(c: Column, step: float) -> Column:
    """The multiple of step that half a step more is cut to, towards zero."""
    return (c / F.lit(float(step)) + F.lit(0.5)).cast("long") * F.lit(float(step))


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("long")


def bucket(c: Column | str) -> Column:
    c = _c(c)
    return F.when(c >= 0.85, "high").when(c >= 0.6, "medium").otherwise("low")


def tokens(c: Column | str) -> Column:
    """Estimated tokens: the larger of a count by characters and one by words; wide scripts count by character."""
    c = _c(c)
    wide = count_matches(c, WIDE)
    marked = F.regexp_replace(c, WIDE, "\x01")
    word = r"[\p{L}\p{Nd}]+"
    words = count_matches(marked, word) - count_matches(marked, word + "\x01")
    by_chars = (F.length(c) - wide) / F.lit(3.8) + wide * F.lit(1.05).cast("double")
    by_words = words * F.lit(1.33).cast("double") + wide * F.lit(1.05).cast("double")
    return F.when(F.length(c) == 0, F.lit(0).cast("long")).otherwise(half_up(F.greatest(by_chars, by_words, F.lit(1.0))))


def tokens_of_length(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(half_up(n / F.lit(3.8)))


def html_tokens(c: Column | str) -> Column:
    """Estimated tokens of markup: script bytes are denser than the rest."""
    c = _c(c)
    scripts = F.regexp_extract_all(c, F.lit(r"((?is)<script.*?</script>)"))
    dense = F.aggregate(scripts, F.lit(0), lambda n, x: n + F.octet_length(x) - 9)
    return half_up((F.octet_length(c) - dense) / F.lit(2.9) + dense / F.lit(2.3))


def unescape(c: Column | str) -> Column:
    """The five escapes of markup, as they are written in full, decoded once; anything else stays as it is."""
    c = _c(c)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markup_title(html: Column | str) -> Column:
    """The first title as the markup has it: a browser also reads an escape that was cut short (&amp), this leaves it."""
    return collapse(unescape(F.regexp_extract(_c(html), TITLE, 1)))


def markup_text(c: Column | str) -> Column:
    """What a plain strip of tags leaves, white space (ASCII) collapsed."""
    c = _c(c)
    for pattern in HIDDEN_ELEMENTS:
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, TAG, " "), r"[\t\n\f\r ]+", " "))


def visible_bytes(c: Column | str) -> Column:
    c = F.regexp_replace(_c(c), r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    return F.octet_length(collapse(F.regexp_replace(c, r"<[^>]*>", " ")))


def lexical(c: Column | str) -> Column:
    return _c(c).rlike(r"[\p{L}\p{Nd}]")


def uppercase(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"\P{L}", "").rlike(r"^\p{Lu}{3,}$")


def closes_like_prose(c: Column | str) -> Column:
    """Ends in a sentence's mark and not in an initial of at most two letters."""
    c = F.trim(_c(c))
    return c.rlike(r"[.;,…]$") & ~c.rlike(r"(^|[ ])\p{L}{1,2}\.$")


def hydration_prose(c: Column | str) -> Column:
    """Whether a payload string reads as prose rather than machinery."""
    c = _c(c)
    n = F.length(c)
    return (
        n.between(12, 600) & ~c.rlike(r"^(https?://|data:|[/#.{<])") & F.trim(c).contains(" ")
        & (count_matches(c, rf"(?:\p{{L}}|{SPACE})") >= n * F.lit(0.75).cast("double")) & (count_matches(c, "_") <= 2) & (count_matches(c, r"\.") <= 3)
    )


def hydration_label(c: Column | str) -> Column:
    """Whether a payload string reads as a link's label."""
    c = _c(c)
    n = F.length(c)
    return n.between(2, 80) & ~c.startswith("http") & ~c.rlike(r"[{}\[\]<>|\\]") & (count_matches(c, rf"(?:[\p{{L}}&'-]|{SPACE})") >= n * F.lit(0.85).cast("double"))


def contact(c: Column | str) -> Column:
    return _c(c).rlike(r"(?i)^\s*(mailto|tel|sms):")


def normal_form(c: Column | str) -> Column:
    """Quotes, dashes, spaces and case folded, for confirming text against a corpus."""
    c = F.translate(_c(c), "‘’‚‛′“”„″‐‑‒–—―−", "'''''\"\"\"\"-------")
    return F.lower(collapse(F.replace(c, F.lit("…"), F.lit("..."))))


def clauses(c: Column | str) -> Column:
    """Parts of at least 16 bytes between marks, longest first; equals stay in order."""
    parts = F.filter(F.transform(F.split(_c(c), r"[.,;:\n!?—–|]"), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")), lambda x: F.octet_length(x) >= 16)
    keyed = F.transform(parts, lambda x, i: F.struct((-F.octet_length(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def significant_words(c: Column | str) -> Column:
    words = F.transform(F.split(F.lower(collapse(c)), " "), lambda w: F.btrim(w, F.lit(".,;:!?\"'()")))
    return F.filter(words, lambda w: (F.octet_length(w) >= 4) & ~w.isin(*STOP_WORDS))


def stem(w: Column) -> Column:
    out = w
    for suffix in ("s", "ed", "es", "ing"):  # the last that applies is the first to try
        out = F.when((F.octet_length(w) > len(suffix) + 3) & w.endswith(suffix), F.regexp_replace(w, suffix + "$", "")).otherwise(out)
    return out


def fact_present(text: Column, fact: Column) -> Column:
    """Whether at least 0.7 of the fact's significant words, or their stems, are in text (lower case)."""
    words = significant_words(fact)
    hits = F.size(F.filter(words, lambda w: text.contains(w) | text.contains(stem(w))))
    return F.when(F.size(words) == 0, text.contains(F.lower(fact))).otherwise(hits / F.size(words) >= F.lit(0.7).cast("double"))


def shell(c: Column | str) -> Column:
    """Whether a response is a page that has not arrived: a marker phrase, or hardly any words."""
    c = _c(c)
    return F.lower(c).rlike("|".join(SHELL_MARKERS)) | (count_matches(c, r"[A-Za-z][A-Za-z'-]+") * 6 < 220)


def html_escape(c: Column | str) -> Column:
    c = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def markdown_escape(c: Column | str) -> Column:
    """Marks that Markdown reads escaped: everywhere, at word edges only (_), or at the start of a line only."""
    c = F.regexp_replace(_c(c), r"(?<![A-Za-z0-9\x{80}-\x{10ffff}])_|_(?![A-Za-z0-9\x{80}-\x{10ffff}])", r"\\_")
    c = F.regexp_replace(c, r"([|*`\[\]])", r"\\$1")
    c = F.regexp_replace(c, r"(?md)^([ \t]*)([#>+-])", r"$1\\$2")
    return F.regexp_replace(c, r"(?md)^([ \t]*[0-9])([.)])", r"$1\\$2")


def yaml_string(c: Column | str) -> Column:
    c = _c(c)
    quoted = F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when((c == "") | c.rlike(r"[:#\[\]{}&*!|>'\"%@`,\n]|^[ -]|[ ]$"), quoted).otherwise(c)


def snippet(c: Column, at: Column, width: int) -> Column:
    """width characters of c from a third before place `at` (0-based), with ellipses where it is cut."""
    start = F.greatest(at - width // 3, F.lit(0))
    end = F.least(start + width, F.length(c))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substring(c, start + 1, end - start)), F.when(end < F.length(c), "…").otherwise(""))


# Strings of operators that prose doesn't have, typefaces of code, words of controls that nobody presses for a reader.
CODE_TOKENS = ("{", "}", ";", "=>", "->", "::", "()", "):", "&&", "||", "==", "!=", "</", "/>")
MONOSPACE = ("mono", "courier", "consolas", "menlo", "fira code", "source code")
REFUSED = (
    r"(?i)\b(18|21)\+?\b|over\s*(18|21)|of\s+legal\s+age|\bi\s*am\b|i'?m\s+over|accept|agree|consent|cookie|privacy|terms|gdpr|allow\s+all|sign\s*in|sign\s*up|log\s*in|register|subscribe|newsletter|\bbuy\b|purchase|checkout|add\s+to\s+(cart|bag)|\bpay\b|\border\b|donate|delete|remove|submit|\bsend\b|download|install"
)
SYMBOL = r"[!-/:-@\[-`{-~]"
PROSE_SYMBOL = r"[.,'\-:?!]"


def looks_like_code(c: Column | str) -> Column:
    """Whether a run has the syntax of code: an operator, a flag, an identifier, or over 12 % symbols."""
    c = _c(c)
    operator = F.lit(False)
    for t in CODE_TOKENS:
        operator = operator | c.contains(t)
    identifier = ~c.contains(" ") & (c.contains("_") | c.rlike(r"\p{Ll}.*\p{Lu}"))
    symbols = count_matches(c, SYMBOL) - count_matches(c, PROSE_SYMBOL)
    return operator | c.rlike("--[A-Za-z]") | identifier | (symbols > F.length(c) * F.lit(0.12).cast("double"))


def monospace(family: Column | str) -> Column:
    return F.lower(_c(family)).rlike("|".join(MONOSPACE))


def refused(c: Column | str) -> Column:
    """Whether a control's label asks for something that only a visitor may say."""
    return _c(c).rlike(REFUSED)


def cut_bytes(c: Column, n: int) -> Column:
    """As many whole characters as n bytes hold."""
    return F.rtrim(F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string")), F.lit("\ufffd"))


def excerpt(c: Column | str, n: int = 400) -> Column:
    """White space collapsed, at most n bytes with the ellipsis."""
    c = collapse(c)
    return F.when(F.octet_length(c) <= n, c).otherwise(F.concat(cut_bytes(c, n - 3), F.lit("…")))


def json_within(c: Column | str) -> Column:
    """From the first brace to the last one, of what stands in a fence if there is one."""
    c = F.trim(_c(c))
    fenced = F.regexp_extract(c, r"(?s)```[^\n]*\n?(.*?)(?:```|$)", 1)
    inner = F.when(c.contains("```"), fenced).otherwise(c)
    braced = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    return F.when(braced != "", braced).otherwise(inner)


def written_at(c: Column | str) -> Column:
    """A time as RFC 3339 in UTC, to the second."""
    return F.date_format(_c(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def noscript_warning(c: Column | str) -> Column:
    c = F.lower(_c(c))
    return c.rlike("javascript|js") & c.rlike("enable|require|need|turn on|activate|support")


def literal_prose(c: Column | str) -> Column:
    """Whether a script's string reads as a phrase: a space, and more letters than other ASCII characters."""
    c = _c(c)
    letters = count_matches(c, "[A-Za-z]") + F.octet_length(F.regexp_replace(c, r"[\x00-\x7f]", ""))
    other = count_matches(c, r"[\x00-\x7f]") - count_matches(c, "[A-Za-z ]")
    return (F.octet_length(c) <= 4096) & (letters > 0) & c.contains(" ") & (letters > other)
