"""Problem 7: evaluation texts leaking into training text.

The n-grams of the items' own passages are hashed into a sorted set that every task holds, a block of items at a time;
the documents' token windows are scanned against it, and hits are verified by chaining them, in order, into a covered
share of the passage.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.skew import lookup_join, salted_sum
from plumbline.session import parallelism, stage, table

#: Tokens a window: words, and characters of scripts written without spaces.
N_WORDS, N_CHARS = 5, 8
#: Items are processed in blocks of about so many tokens, which bounds what the driver sends and a task holds. A single
#: item may not have more.
BLOCK = 500_000
SHARE = 0.31
#: Runs of a piece are parted by at most so many tokens, or thrice as many if two fifths of them are common.
GAP = 4

_UNSPACED = "぀-ヿ㐀-鿿豈-﫿฀-๿"
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>")
_HIDDEN = re.compile("[­​‌‍﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐]\r?\n\s*(?=[^\W\d_])")
_INNER = re.compile(r"[.,:](?<=\d.)(?=\d)|\.(?<=\b[^\W\d_]\.)(?=[^\W\d_]\b)|['’](?<=\w.)(?=\w)")
_TOKEN = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")
_CHAR = re.compile(rf"[{_UNSPACED}]")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    """Words, or characters of unspaced scripts, apart from case, marks, tags, entities and broken lines."""
    if "<" in text:
        text = _TAG.sub(" ", text.replace("<i>", "").replace("</i>", "").replace("<b>", "").replace("</b>", ""))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    text = text.casefold()
    if "-\n" in text or "-\r" in text or "‐" in text:
        text = _BROKEN.sub("", text)
    return _TOKEN.findall(_INNER.sub("", text))


def item_tokens(items: DataFrame) -> DataFrame:
    """``(item_id, suite, toks)``: each item's tokens; of differing repeats the first, null ids and texts left out."""
    one = items.where("item_id is not null and text is not null").groupBy("item_id").agg(
        F.min(F.struct(F.coalesce("suite", F.lit("")).alias("suite"), "text")).alias("x")).select("item_id", "x.*")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "suite": pdf["suite"], "toks": [tokens(t) for t in pdf["text"]]})

    return one.mapInPandas(cut, "item_id long, suite string, toks array<string>")


def own_passages(items: DataFrame) -> DataFrame:
    """``(item_id, toks)`` without the instruction: the longest prefix that more than half of the item's suite shares,
    as far as the item has it. ``items`` as of ``item_tokens``; a suite with one item has no instruction."""

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for item, suite, toks in zip(pdf["item_id"], pdf["suite"], pdf["toks"]):
                h, out = 0, []
                for t in toks:
                    h = xxhash.xxh64_intdigest(t, h)
                    out.append(h - (1 << 63))
                yield pd.DataFrame({"item_id": item, "suite": suite, "depth": np.arange(1, len(out) + 1), "h": np.array(out, "int64")})

    p = stage(items.mapInPandas(prefixes, "item_id long, suite string, depth long, h long"))
    sizes = items.groupBy("suite").agg(F.count("*").alias("all")).where("`all` > 1")
    common = p.groupBy("suite", "depth", "h").agg(F.count("*").alias("n")).join(sizes, "suite").where("2 * n > `all`")
    lead = p.join(common, ["suite", "depth", "h"]).groupBy("item_id").agg(F.max("depth").cast("int").alias("lead"))
    own = F.expr("slice(toks, coalesce(lead, 0) + 1, greatest(size(toks) - coalesce(lead, 0), 0))")
    return items.join(lead, "item_id", "left").select("item_id", own.alias("toks"))


def marked_passages(items: DataFrame) -> DataFrame:
    """``(item_id, toks, rare, block)``: own passages, which of their tokens hardly any other item has (such as names
    and numbers), and blocks of about ``BLOCK`` tokens in the order of the ids."""
    own = stage(own_passages(stage(item_tokens(items))))
    long = stage(own.select("item_id", F.posexplode("toks").alias("pos", "tok")))
    often = stage(long.groupBy("tok").agg(F.count_distinct("item_id").alias("items"), F.count("*").alias("n")))
    few = max(2, own.count() // 50)
    rare = often.where(F.col("items") <= few).select("tok", F.lit(True).alias("rare"))
    flags = lookup_join(long, rare, "tok", often.select("tok", "n")).groupBy("item_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("rare", F.lit(False)).alias("rare")))), lambda x: x["rare"]).alias("rare"))
    sized = own.join(flags, "item_id").withColumn("size", F.size("toks"))
    longest = sized.agg(F.max("size")).first()[0] or 0
    if longest > BLOCK:
        raise ValueError(f"an evaluation item has {longest} tokens, more than the {BLOCK} of a block")
    before = salted_sum(sized.select("item_id", "size"), [], [F.col("item_id")],
                        F.pmod(F.xxhash64("item_id"), F.lit(parallelism(items.sparkSession))), "before", F.col("size"))
    return sized.join(before.select("item_id", F.floor(F.col("before") / BLOCK).alias("block")), "item_id").drop("size")


def window_codes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit code of every window of ``n`` ids; windows with an id of 0 (a word no item has) get code 0."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    m = len(ids) - n + 1
    code, known = np.zeros(m, np.uint64), np.ones(m, bool)
    for k in range(n):
        part = ids[k : k + m]
        code = (code ^ part) * _MULT
        code ^= code >> np.uint64(29)
        known &= part != 0
    return np.where(known, code, np.uint64(0))


def _common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``b`` of a longest common subsequence of two short runs."""
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for x in range(n - 1, -1, -1):
        for y in range(m - 1, -1, -1):
            t[x][y] = t[x + 1][y + 1] + 1 if a[x] == b[y] else max(t[x + 1][y], t[x][y + 1])
    x = y = 0
    out = []
    while x < n and y < m:
        if a[x] == b[y]:
            out.append(y)
            x, y = x + 1, y + 1
        elif t[x + 1][y] >= t[x][y + 1]:
            x += 1
        else:
            y += 1
    return out


def _reach(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in ``b`` that agree with ``a`` from their start on, over single tokens changed, lost or added that two
    agreeing ones follow."""
    x, y, got, size = 0, 0, [], (len(a), len(b))
    while x < size[0] and y < size[1]:
        if a[x] == b[y]:
            got.append(y)
            x, y = x + 1, y + 1
            continue
        for dx, dy in ((1, 1), (1, 0), (0, 1)):
            u, v = x + dx, y + dy
            if u + 1 < size[0] and v + 1 < size[1] and a[u] == b[v] and a[u + 1] == b[v + 1]:
                x, y = u, v
                break
        else:
            break
    return got


class ItemIndex:
    """The items' windows: sorted codes with, for each, the (item, position) pairs it has."""

    def __init__(self, passages: pd.DataFrame):
        self.vocab: dict[str, int] = {}
        self.items = passages["item_id"].astype(int).tolist()
        self.rare = [np.asarray(x, bool) for x in passages["rare"]]
        self.ids, self.n = [], []
        found = defaultdict(list)
        for k, toks in enumerate(passages["toks"]):
            ids = np.array([self.vocab.setdefault(t, len(self.vocab) + 1) for t in toks], np.uint64)
            n = N_CHARS if 2 * sum(bool(_CHAR.match(t)) for t in toks) > len(toks) else N_WORDS
            n = max(1, min(n, len(ids)))
            self.ids.append(ids)
            self.n.append(n)
            codes = window_codes(ids, n)
            found[n].append((codes, np.full(len(codes), k), np.arange(len(codes))))
        self.sizes = np.array([max(1, len(x)) for x in self.ids])
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in self.ids])]).astype(np.int64)
        self.all_ids = np.concatenate([*self.ids, np.empty(0, np.uint64)]).astype(np.int64)
        self.all_rare = np.concatenate([*self.rare, np.empty(0, bool)])
        self.sets = {}
        for n, parts in found.items():
            codes, item, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((pos, item, codes))
            keys, first = np.unique(codes[order], return_index=True)
            if len(keys):
                self.sets[n] = (keys, np.append(first, len(codes)), np.stack([item[order], pos[order]], 1))

    def scan(self, text: str, share: float) -> list[tuple[int, float]]:
        """(item, covered share) of the items whose passage ``text`` holds to at least ``share``."""
        toks = tokens(text)
        get = self.vocab.get
        ids = np.array([get(t, 0) for t in toks], np.uint64)
        if not ids.any():
            return []
        present = np.zeros(len(self.vocab) + 1, bool)
        present[ids.astype(np.int64)] = True
        out = []
        for n, (keys, offsets, flat) in self.sets.items():
            if n == N_CHARS and not _CHAR.search(text):
                continue
            codes = window_codes(ids, n)
            where = np.flatnonzero(codes)
            if not len(where):
                continue
            at = np.searchsorted(keys, codes[where])
            at[at == len(keys)] = 0
            ok = keys[at] == codes[where]
            where, at = where[ok], at[ok]
            if not len(at):
                continue
            many = offsets[at + 1] - offsets[at]
            dpos = np.repeat(where, many)
            ends = np.cumsum(many)
            pick = np.arange(ends[-1]) - np.repeat(ends - many, many) + np.repeat(offsets[at], many)
            item, ipos = flat[pick, 0], flat[pick, 1]
            # no more can agree than the tokens that are there at all, and without any rare one none count
            met = np.unique(item)
            sizes = self.first[met + 1] - self.first[met]
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at = np.arange(sizes.sum()) - np.repeat(start - self.first[met], sizes)
            there = present[self.all_ids[at]]
            enough = np.add.reduceat(there, start, dtype=np.int64) >= share * sizes
            if n != N_CHARS:
                enough &= np.add.reduceat(there & self.all_rare[at], start, dtype=np.int64) > 0
            for k in met[enough].tolist():
                mine = item == k
                got = self._covered(ids, k, list(zip(dpos[mine].tolist(), ipos[mine].tolist())))
                if got >= share * self.sizes[k]:
                    out.append((self.items[k], got / float(self.sizes[k])))
        return out

    def _covered(self, ids: np.ndarray, k: int, pairs: list[tuple[int, int]]) -> int:
        """Tokens of item ``k`` in the best chain of common runs that keeps the passage's order."""
        item, n = self.ids[k], self.n[k]
        runs: dict[int, list[list[int]]] = defaultdict(list)  # by diagonal: [document start, item start, length]
        for d, i in sorted(pairs):
            r = runs[d - i]
            if r and d <= r[-1][0] + r[-1][2]:
                r[-1][2] = max(r[-1][2], d + n - r[-1][0])
            else:
                r.append([d, i, n])
        blocks = sorted(b for r in runs.values() for b in r)
        # runs that only a few changed words part are one piece: document start, end, item start, end, agreeing places
        pieces: list[list] = []
        open_: list[list] = []
        for d, i, size in blocks:
            open_ = [p for p in open_ if d - p[1] <= 3 * GAP]  # the others are too far back to go on
            for p in open_:
                gd, gi = d - p[1], i - p[3]
                if -n < gd <= 3 * GAP and -n < gi <= 3 * GAP and d > p[0] and i > p[2]:
                    same = _common(ids[p[1] : d], item[p[3] : i]) if gd > 0 and gi > 0 else []
                    if max(gd, gi) > GAP and len(same) < 0.4 * max(gd, gi):
                        continue
                    p[4].update(p[3] + y for y in same)
                    p[4].update(range(max(i, p[3]), i + size))
                    p[1], p[3] = max(p[1], d + size), max(p[3], i + size)
                    break
            else:
                pieces.append([d, d + size, i, i + size, set(range(i, i + size))])
                open_.append(pieces[-1])
        kept = []
        for d0, d1, i0, i1, there in pieces:
            if n == N_CHARS:
                if len(there) >= 5 * n // 2:
                    kept.append((d0, i0, there))
                continue
            there |= {i1 + y for y in _reach(ids[d1:], item[i1:])}
            there |= {i0 - 1 - y for y in _reach(ids[:d0][::-1], item[:i0][::-1])}
            own = self.rare[k][min(there) : max(there) + 1].sum()
            met = sum(self.rare[k][y] for y in there)
            if len(there) >= 8 and met and met >= 0.6 * own:
                kept.append((d0, i0, there))
        kept.sort(key=lambda p: (p[0], p[1]))
        best: list[set] = []
        for x, (d, i, there) in enumerate(kept):
            top = there
            for y in range(x):
                if kept[y][1] < i and len(best[y] | there) > len(top):
                    top = best[y] | there
            best.append(top)
        return max(map(len, best), default=0)


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """``(doc_id, item_id, share)``: documents that hold at least ``share`` of an item's own passage.

    Common runs of ``N_WORDS`` words (``N_CHARS`` characters) or more are joined to pieces over a few changed words.
    Pieces count, in the passage's order, if they agree in most of the names, numbers and other words that hardly any
    other item has; so sentences of the same build about other names do not. Pieces of unspaced scripts, where words
    cannot be told apart, count from 20 characters on. Instructions and rare tokens are found over all items; then they
    are read in blocks of about ``BLOCK`` tokens, wherever suites end, each block against all documents. Null ids and null or empty texts match nothing; repeated rows count once; empty tables give
    no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    marked = stage(marked_passages(items))
    blocks = sorted(r[0] for r in marked.select("block").distinct().collect())
    out = None
    schema = "doc_id long, item_id long, share double"
    for block in blocks:
        part = marked.where(F.col("block") == block).orderBy("item_id").toPandas()
        index = spark.sparkContext.broadcast(ItemIndex(part))

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            look = index.value
            for pdf in batches:
                rows = [
                    (doc, item, got) for doc, text in zip(pdf["doc_id"], pdf["text"]) for item, got in look.scan(text, share)
                ]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "share"])

        texts = documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text")
        found = texts.mapInPandas(scan, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation item that leaked: in how many documents, and the largest share found in one."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    per = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))
    return table(spark, sf_dir, "eval_items").select("item_id", "suite", "split").join(per, "item_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold no item's passage."""
    docs = table(spark, sf_dir, "documents")
    found = leaks(docs, table(spark, sf_dir, "eval_items")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select("doc_id", "source", "lang")
