"""Words in 3D assets: names that authors gave, and sentences in free-form extras, of glTF (JSON) and GLB (chunks) files.

A kernel reads one file a row and emits raw strings in document order; the summary is a column expression. A file that
is neither format, or whose JSON isn't an object of the expected shape, gives no row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources.structured import parsed

# Names that say nothing, and limits.
GENERIC = frozenset(
    "object mesh cube sphere plane cylinder node scene material group empty root armature camera light circle cone torus "
    "default untitled collection geometry primitive lambert phong mat".split()
) | {"standard surface"}
JSON_BYTES, NAME_BYTES, EXTRA_DEPTH, EXTRA_TEXTS, SAID_NAMES = 64 << 20, 120, 6, 200, 24

_CAMEL = regex.compile(r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
_DIGITS = regex.compile(r"\p{Nd}+")
_LETTER = regex.compile(r"\p{L}")


def _size(s: str) -> int:
    return len(s.encode("utf-8", "surrogatepass"))


def clean_name(name: str) -> str:
    """A name as words, "" where it carries no information."""
    name = name.strip()
    if _size(name) > NAME_BYTES:
        return ""
    words = [w for w in regex.split(r"[_.|:-]+", name) if w and not _DIGITS.fullmatch(w) and (_size(w) > 1 or w.isalpha())]
    out = " ".join(_CAMEL.sub(" ", " ".join(words)).split())
    first, _, rest = out.lower().partition(" ")
    generic = out.lower() in GENERIC or first in GENERIC and (rest in GENERIC or bool(_DIGITS.fullmatch(rest)))
    return "" if _size(out) < 3 or generic else out


def sentence(s: str) -> str:
    """s if it reads as language: some space, letters for half its bytes, no markup and no address."""
    s = s.strip()
    n = _size(s)
    if not 8 <= n <= 600 or regex.search(r"[{}<>]|://", s):
        return ""
    return s if " " in s and 2 * len(_LETTER.findall(s)) >= n else ""


def _strings(value, depth: int = 0) -> Iterator[str]:
    if depth > EXTRA_DEPTH:
        return
    if isinstance(value, str):
        if said := sentence(value):
            yield said
    elif isinstance(value, (list, dict)):
        for x in value if isinstance(value, list) else (value[k] for k in sorted(value)):
            yield from _strings(x, depth + 1)


def _first_of_each(values) -> list[str]:
    out: dict[str, str] = {}
    for v in values:
        if v:
            out.setdefault(v.lower(), v)
    return list(out.values())


def json_chunk(body: bytes) -> bytes | None:
    """The JSON of a glTF file: the whole of it, or the first JSON chunk of its binary form."""
    if body[:4] != b"glTF" or len(body) < 12:
        return body if body[:64].lstrip()[:1] == b"{" and len(body) <= JSON_BYTES else None
    end, at = min(len(body), struct.unpack_from("<I", body, 8)[0]), 12
    while at + 8 <= end:
        size, kind = struct.unpack_from("<I4s", body, at)
        at += 8
        if size > JSON_BYTES or at + size > len(body):
            return None
        if kind == b"JSON":
            return body[at : at + size]
        at += size + -(at + size) % 4
    return None


def read(body: bytes | None) -> dict | None:
    """generator, copyright, names, texts, n_nodes, n_meshes of a file's bytes."""
    raw = json_chunk(body) if body else None
    doc = parsed(raw.decode("utf-8", "replace")) if raw else None
    if not isinstance(doc, dict):
        return None
    lists = {k: doc.get(k) or [] for k in ("scenes", "nodes", "meshes", "materials", "images")}
    asset = doc.get("asset") or {}
    items = [x for v in lists.values() if isinstance(v, list) for x in v]
    named = [*((x.get("name") if isinstance(x, dict) else 0) or "" for x in items), *(asset.get(k) or "" for k in ("generator", "copyright"))] if isinstance(asset, dict) else [0]
    if not all(isinstance(v, list) for v in lists.values()) or not all(isinstance(x, dict) for x in items) or not all(isinstance(x, str) for x in named):
        return None
    extras = [x.get("extras") for k in ("scenes", "nodes", "meshes") for x in lists[k]] + [doc.get("extras"), asset.get("extras")]
    texts: list[str] = []
    for s in (s for e in extras for s in _strings(e)):
        texts.append(s)
        if len(texts) > EXTRA_TEXTS:
            break
    return {
        "generator": named[-2].strip(), "copyright": named[-1].strip(), "names": _first_of_each(map(clean_name, named[:-2])),
        "texts": _first_of_each(texts), "n_nodes": len(lists["nodes"]), "n_meshes": len(lists["meshes"]),
    }


def scenes(assets: DataFrame) -> DataFrame:
    """page_id, url, generator, copyright, names, texts, n_nodes, n_meshes, text of assets (page_id, url, body); text says
    what was found and where, "" if nothing was."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("generator", pa.string()), ("copyright", pa.string()), ("names", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("n_nodes", pa.int64()), ("n_meshes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ({"page_id": p, "url": u, **found} for p, u, x in zip(*(b.column(i).to_pylist() for i in range(3))) if (found := read(x)))
            yield pa.RecordBatch.from_pylist(list(rows), schema=kinds)

    rows = assets.select(F.col("page_id").cast("long").alias("page_id"), "url", "body")
    rows = rows.mapInArrow(run, "page_id long, url string, generator string, copyright string, names array<string>, texts array<string>, n_nodes long, n_meshes long")
    listed = F.when(F.size("names") > 0, F.concat(F.lit("3D scene contains: "), F.array_join(F.slice("names", 1, SAID_NAMES), ", ")))
    credit = F.when(F.col("copyright") != "", F.concat(F.lit("Credited to "), F.col("copyright")))
    return rows.withColumn("text", F.concat_ws(". ", listed, "texts", credit))
