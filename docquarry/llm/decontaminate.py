"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are those of text.py.  Every run of N words of an item is a window; an
item of fewer words, but not none, is one window.  The sorted 64-bit hashes of
the windows are broadcast; document windows are looked up in them, each hit is
verified word by word against the item, and all words inside verified windows
are hit.  Documents are only mapped over: no shuffle, no state per document
group, any length of text.

What is broadcast is bounded: items are divided by hash into blocks of at most
`index_bytes` of text, measured beforehand.  With more than one block the
documents are written once and scanned for one block after another, so that only
one is in a worker's memory at a time; a scan leaves rows for the documents that
it hits, which are few, and they are joined back by row at the end.

Defined cases: null or empty text has no words and is clean; null item text
has no windows; a null item id is the string "null"; items that repeat an id
count once; repeated documents are each judged; without items all is clean; a
very long text is hashed in pieces; columns with the names of the results are
replaced by find(), and all others, or all in decontaminate(), stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import sliced, small_batches, with_columns
from .storage import written
from .text import FOLD, encoded, shingle_hashes, word_hashes

N = 10
INDEX_BYTES = 4 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Added by find(); spans are of bytes of the UTF-8 text.
FOUND = "n_words bigint, n_hit bigint, items array<string>, hits array<struct<start:bigint,end:bigint>>"


def _words(text: str | None) -> list[tuple[int, int, bytes]]:
    return [(m.start(), m.end(), m.group()) for m in _WORD.finditer(encoded(text).translate(FOLD))]


class WindowIndex:
    """The windows of some items: for each window length sorted hashes with item and place."""

    def __init__(self, rows: list[tuple[str | None, str | None]], n: int = N):
        self.ids = ["null" if i is None else str(i) for i, _ in rows]
        self.words = [[w for _, _, w in _words(t)] for _, t in rows]
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, hashes in enumerate(word_hashes(t for _, t in rows)):
            if len(hashes):
                by_length.setdefault(min(n, len(hashes)), []).append((shingle_hashes(hashes, n), item))
        self.tables = {}
        for length, parts in by_length.items():
            hashes = np.concatenate([h for h, _ in parts])
            item = np.concatenate([np.full(len(h), i, np.int32) for h, i in parts])
            place = np.concatenate([np.arange(len(h), dtype=np.int32) for h, _ in parts])
            order = np.argsort(hashes, kind="stable")
            self.tables[length] = hashes[order], item[order], place[order]

    def search(self, text: str | None, hashes: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Which words are hit, and the ids of the items with verified windows."""
        hit = np.zeros(len(hashes), bool)
        items: set[int] = set()
        words = None
        for length, (known, item, place) in self.tables.items():
            if len(hashes) < length:
                continue
            windows = shingle_hashes(hashes, length)
            low = np.searchsorted(known, windows)
            for at in np.flatnonzero(known[np.minimum(low, len(known) - 1)] == windows):
                if words is None:
                    words = [w for _, _, w in _words(text)]
                here = words[at : at + length]
                k = int(low[at])
                while k < len(known) and known[k] == windows[at]:
                    i, p = int(item[k]), int(place[k])
                    if self.words[i][p : p + length] == here:
                        items.add(i)
                        hit[at : at + length] = True
                    k += 1
        return hit, sorted({self.ids[i] for i in items})


def _blocks(benchmark: DataFrame, id_col: str, text: str, index_bytes: int) -> list[DataFrame]:
    """The items in blocks of at most index_bytes of text each (or of one item)."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null").dropDuplicates()
    size = F.octet_length("text") + F.lit(16)
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // index_bytes))
    while n > 1:
        part = F.pmod(F.xxhash64("id", "text"), F.lit(n))
        most = items.groupBy(part.alias("part")).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("k")).where("k > 1").agg(F.max("bytes")).first()[0] or 0
        if most <= index_bytes:
            return [items.where(part == b) for b in range(n)]
        n *= 2
    return [items]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (ids with a verified window, sorted as strings) and hits (byte spans)."""
    blocks = _blocks(benchmark, item_id, item_text, index_bytes)
    spark = docs.sparkSession
    if len(blocks) == 1:
        index = spark.sparkContext.broadcast(_index(blocks[0], n))

        def kernel(found: WindowIndex, texts: list) -> dict[str, pa.Array]:
            return _columns([(t, *found.search(t, hashes)) for t, hashes in zip(texts, word_hashes(texts), strict=True)])

        return with_columns(docs, text, kernel, FOUND, lambda: index.value)
    # several blocks: each pass leaves rows for the documents that it hits only
    held = written(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
    parts = []
    for block in blocks:
        index = spark.sparkContext.broadcast(_index(block, n))
        parts.append(written(_hit(held.select("__row", F.col(f"`{text}`").alias("text")), index), "hits"))
        index.unpersist()
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionAll(part)
    marks = hits.groupBy("__row").agg(F.collect_list("marks").alias("marks"), F.flatten(F.collect_list("items")).alias("items"))
    fed = held.join(marks, "__row", "left").withColumn("__fed", F.struct(F.col(f"`{text}`").alias("text"), "marks", "items")).drop("__row", "marks", "items")

    def merge(rows: list) -> dict[str, pa.Array]:
        made = []
        for row, hashes in zip(rows, word_hashes([r["text"] for r in rows]), strict=True):
            hit = np.zeros(len(hashes), bool)
            for m in row["marks"] or []:
                hit |= np.unpackbits(np.frombuffer(m, np.uint8), count=len(hit)).astype(bool)
            made.append((row["text"], hit, sorted({*(row["items"] or [])})))
        return _columns(made)

    return with_columns(fed, "__fed", merge, FOUND).drop("__fed")


def _index(block: DataFrame, n: int) -> WindowIndex:
    return WindowIndex([(r["id"], r["text"]) for r in block.collect()], n)


def _hit(texts: DataFrame, index) -> DataFrame:
    """(__row, marks, items) of the texts with a verified window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: WindowIndex = index.value
        for batch in sliced(batches):
            rows, marks, items = [], [], []
            given = batch.column("text").to_pylist()
            for row, t, hashes in zip(batch.column("__row").to_pylist(), given, word_hashes(given), strict=True):
                hit, own = found.search(t, hashes)
                if own:
                    rows.append(row)
                    marks.append(np.packbits(hit).tobytes())
                    items.append(own)
            yield pa.RecordBatch.from_pydict({"__row": pa.array(rows, pa.int64()), "marks": pa.array(marks, pa.binary()), "items": pa.array(items, pa.list_(pa.string()))})

    small_batches(texts)
    return texts.mapInArrow(run, "__row bigint, marks binary, items array<string>")


def _columns(found: list[tuple[str | None, np.ndarray, list[str]]]) -> dict[str, pa.Array]:
    """Of each text, which words are hit and by which items."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return {
        "n_words": pa.array([len(hit) for _, hit, _ in found], pa.int64()),
        "n_hit": pa.array([int(hit.sum()) for _, hit, _ in found], pa.int64()),
        "items": pa.array([items for _, _, items in found], pa.list_(pa.string())),
        "hits": pa.array([_spans(t, hit) if hit.any() else [] for t, hit, _ in found], kind),
    }


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    places = _words(text)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(turn[0::2].tolist(), turn[1::2].tolist(), strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **settings) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") with the hit spans cut out of their texts."""
    columns = docs.columns
    kept = [F.col(f"`{c}`") for c in columns]
    tagged = find(docs.select(F.struct(*kept).alias("__doc"), F.col(f"`{text}`").alias("__text")), benchmark, text="__text", **settings)
    if remove == "documents":
        return tagged.where("n_hit = 0").select("__doc.*")

    def kernel(rows: list) -> dict[str, pa.Array]:
        out = []
        for r in rows:
            raw, at, parts = encoded(r["text"]), 0, []
            for h in r["hits"]:
                parts.append(raw[at : h["start"]])
                at = h["end"]
            out.append(None if r["text"] is None else (b"".join(parts) + raw[at:]).decode("utf-8", "surrogatepass"))
        return {"__cut": pa.array(out, pa.string())}

    fed = tagged.withColumn("__fed", F.struct(F.col("__text").alias("text"), F.col("hits").alias("hits")))
    cut = with_columns(fed, "__fed", kernel, "__cut string")
    return cut.select("__doc.*", "__cut").withColumn(text, F.col("__cut")).select(*kept)


def digests(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **settings) -> DataFrame:
    """One row per document: the counts and the digest of its items."""
    found = find(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), "text"), benchmark, **settings)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Marks the words that lie in any occurrence of a window, by joining windows on their words.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bp AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win FROM bp),
ns AS (SELECT DISTINCT n FROM bw),
dp AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM dp),
h AS (SELECT dw.r, dw.p, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
hw AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
