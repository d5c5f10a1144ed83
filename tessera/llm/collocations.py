"""Phrase collocations by top-order marginalisation.

Only windows of the highest order are counted: each word with the three that
lead it in its piece, padded at the piece's end. A shorter phrase's count is
the sum of the windows that begin with it, so Spark's ROLLUP over the window's
columns gives the counts of all orders at once.

Before the rollup a window is cut where it can't matter any more. Windows are
dealt by their first two words, so the counts of their first two and three are
known where they lie; what follows a prefix of under ``least`` occurrences is
in no candidate and in no part of one, and becomes padding. Counts of kept
prefixes stay exact, and the rollup sees few rows.

Windows travel as short codes of their words: the most frequent words (at most
MAX_WORDS of LONGEST bytes, broadcast) have one to three letters, all other
words are spelled out. If that table holds *all* words of ``least``
occurrences, other short words are in no candidate, and end a window as well.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, text_or_empty

ORDER = 4
#: Words with codes, their length in bytes at most.
MAX_WORDS, LONGEST = 1 << 18, 64
#: Words counted before a flush, and codes of windows sorted at a time.
DISTINCT, CHUNK = 300_000, 1_000_000
#: Pairs of words that each hold over 1 / HEAVY of all words are dealt to SALTS places by the third word.
HEAVY, SALTS = 1024, 64
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+-"
#: Bytes of texts as the words' rules see them: A-Z lower-cased, what ends a piece as a byte that UTF-8 lacks.
BREAK = b"\xff"
RULES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10)


def words_of(text: str) -> list[bytes]:
    """A text's words in order, with BREAK where a piece ends."""
    return text.encode("utf-8", "surrogatepass").translate(RULES).replace(BREAK, b" \xff ").split()


def code(i: int) -> str:
    """A short text for a number from 1."""
    out = ""
    while i:
        i, d = divmod(i, 64)
        out += DIGITS[d]
    return out


def _documents(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), text_or_empty(text_col).alias("text"))


def count_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, n) of all words; counted in tasks first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts: dict[str, Counter] = {}

        def flush() -> Iterator:
            for lang, own in counts.items():
                own.pop(BREAK, None)
                words = pa.array(list(own), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), words, pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, counts.values())) > DISTINCT:
                    yield from flush()
        yield from flush()

    found = _documents(docs, text_col, lang_col).mapInArrow(run, "lang string, word string, n long")
    return found.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def dictionary(words: DataFrame, least: int, most: int = MAX_WORDS) -> tuple[list[tuple[str, bytes]], int, bool]:
    """The most frequent words by falling count, ``most`` at most; how many of them are heavy; whether all of ``least`` are there.

    Counts are taken by classes of an eighth of an octave, so that no task sorts.
    """
    short = words.where((F.col("n") >= least) & (F.octet_length("word") <= LONGEST)).withColumn("size", F.floor(F.log2(F.col("n").cast("double")) * 8))
    sizes = sorted(((r["size"], r["count"]) for r in short.groupBy("size").count().collect()), reverse=True)  # 512 classes at most
    total, low, complete = 0, None, True
    for size, n in sizes:
        total += n
        if total > most:
            complete = False
            break
        low = size
    if low is None:
        return [], 0, complete
    all_words = words.agg(F.sum("n")).first()[0]
    rows = short.where(F.col("size") >= low).select("lang", "word", "n").toArrow().to_pylist()  # ``most`` at most
    rows.sort(key=lambda r: (-r["n"], r["lang"], r["word"]))
    return [(r["lang"], r["word"].encode()) for r in rows], sum(r["n"] * HEAVY > all_words for r in rows), complete


class Codes(dict):
    """Codes of one language's words; unknown ones are 0 (a break) or get the next number of a chunk."""

    def __init__(self, lang: str, known: dict, spelled: list[str], first: int, cuts: bool):
        super().__init__(known)
        self[BREAK] = 0
        self.lang, self.spelled, self.first, self.cuts, self.new = quote(lang, safe=""), spelled, first, cuts, []

    def __missing__(self, word: bytes) -> int:
        if self.cuts and len(word) <= LONGEST:
            return 0
        self.spelled.append(f"\x01{self.lang}\x01{word.decode('utf-8', 'surrogatepass')}")
        self[word] = out = self.first + len(self.spelled)
        self.new.append(word)
        return out

    def forget(self) -> None:
        for word in self.new:
            del self[word]
        self.new = []


def windows(docs: DataFrame, known: list[tuple[str, bytes]], heavy: int, cuts: bool, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(pair, tail, n): the windows' codes, two words each, counted by chunks; a heavy pair has a salt by its third word.

    Padding is left out, so ``pair`` and ``tail`` hold two codes at most.
    """
    kept = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(kept.value, 1):
            own.setdefault(lang, {})[word] = i
        n = len(kept.value)
        texts, spelled = ["", *map(code, range(1, n + 1))], []
        salts = [zlib.crc32(t.encode()) % SALTS for t in texts]
        tables: dict[str, Codes] = {}

        def flush(parts: list) -> Iterator:
            c = np.concatenate([*parts, np.zeros(ORDER, np.uint64)])
            parts.clear()
            c0 = c[: 1 - ORDER].copy()
            c1, c2, c3 = (c[k : len(c0) + k].copy() for k in (1, 2, 3))
            c1[c0 == 0] = 0
            c2[c1 == 0] = 0
            c3[c2 == 0] = 0
            low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
            pair, tail = (c0 << half | c1)[c0 > 0], (c2 << half | c3)[c0 > 0]
            del c, c1, c2, c3
            order = np.lexsort((tail, pair))
            pair, tail = pair[order], tail[order]
            new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (tail[1:] != tail[:-1])]) if len(pair) else np.zeros(0, np.int64)
            count = np.diff(np.r_[new, len(pair)])
            pair, tail = pair[new], tail[new]
            names = texts + spelled
            salt = np.array(salts + [zlib.crc32(s.encode("utf-8", "surrogatepass")) % SALTS for s in spelled], dtype=np.int64)
            names = pa.array(names, pa.string())
            at = lambda x: names.take(pa.array(x.astype(np.int64)))
            for first in range(0, len(pair), 100_000):
                p, t, k = pair[first : first + 100_000], tail[first : first + 100_000], count[first : first + 100_000]
                a, b, d, e = p >> half, p & low, t >> half, t & low
                salted = (b > 0) & (a <= heavy) & (b <= heavy)
                yield pa.RecordBatch.from_arrays([_joined(at(a), at(b), pa.array(np.where(salted, salt[d.astype(np.int64)], -1))), _joined(at(d), at(e)), pa.array(k, pa.int64())], names=["pair", "tail", "n"])
            spelled.clear()
            for x in tables.values():
                x.forget()

        parts, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (table := tables.get(lang)) is None:
                    table = tables[lang] = Codes(lang, own.pop(lang, {}), spelled, n, cuts)
                found = words_of(text)
                parts += [np.fromiter(map(table.__getitem__, found), np.uint64, len(found)), np.zeros(1, np.uint64)]
                size += len(found) + 1
                if size > CHUNK:
                    yield from flush(parts)
                    size = 0
        if parts:
            yield from flush(parts)

    return _documents(docs, text_col, lang_col).mapInArrow(run, "pair string, tail string, n long")


def _joined(a, b, salt=None):
    """Texts of codes joined by blanks; empty ones, and salts below 0, are left out."""
    import pyarrow as pa
    import pyarrow.compute as pc

    second = pc.if_else(pc.equal(b, ""), "", pc.binary_join_element_wise("", b, " "))
    if salt is not None:
        second = pc.binary_join_element_wise(second, pc.if_else(pc.less(salt, 0), "", pc.binary_join_element_wise("", pc.cast(salt, pa.string()), " ")), "")
    return pc.binary_join_element_wise(a, second, "")


def cut_windows(counted: DataFrame, least: int) -> DataFrame:
    """(w0, w1, w2, w3, n) of windows cut after prefixes of under ``least`` occurrences; '' is padding.

    One shuffle, by pair. A salted pair's sum isn't known in one place, so it
    is taken as frequent: that only keeps more rows.
    """
    rows = counted.repartition("pair").groupBy("pair", "tail").agg(F.sum("n").alias("n"))
    pair, tail = F.split("pair", " "), F.split("tail", " ")
    rows = rows.withColumn("w2", tail[0]).withColumn("f3", F.sum("n").over(Window.partitionBy("pair", "w2"))).withColumn("f2", F.sum("n").over(Window.partitionBy("pair")))
    w1 = F.coalesce(F.get(pair, F.lit(1)), F.lit(""))
    two = (F.col("f2") >= least) | (F.size(pair) > 2)
    three = two & (F.col("f3") >= least)
    cut = rows.select(pair[0].alias("w0"), F.when(two, w1).otherwise("").alias("w1"), F.when(three, F.col("w2")).otherwise("").alias("w2"), F.when(three & (F.col("n") >= least), F.coalesce(F.get(tail, F.lit(1)), F.lit(""))).otherwise("").alias("w3"), "n")
    return cut.groupBy("w0", "w1", "w2", "w3").agg(F.sum("n").alias("n"))


def marginals(cut: DataFrame, least: int) -> DataFrame:
    """(codes array, f): every prefix of the windows that occurs ``least`` times, by ROLLUP."""
    names = [f"w{i}" for i in range(ORDER)]
    sums = cut.rollup(*names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    whole = F.lit(False)
    for k in range(1, ORDER + 1):  # the level of k words has the other columns' bits set, and ends in no padding
        whole = whole | ((F.col("level") == (1 << (ORDER - k)) - 1) & (F.col(names[k - 1]) != ""))
    return sums.where(whole & (F.col("f") >= least)).select(F.filter(F.array(*names), lambda w: w.isNotNull()).alias("codes"), "f")


def spelled_out(found: DataFrame, known: list[tuple[str, bytes]]) -> DataFrame:
    """(lang, words array, f) of codes."""
    kept = found.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = {code(i): (lang, word.decode("utf-8", "surrogatepass")) for i, (lang, word) in enumerate(kept.value, 1)}

        def word(c: str) -> tuple[str, str]:
            if c[0] != "\x01":
                return own[c]
            lang, _, text = c[1:].partition("\x01")
            return unquote(lang), text

        for batch in batches:
            rows = [[word(c) for c in codes] for codes in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), pa.array([[w for _, w in r] for r in rows], pa.list_(pa.string())), batch.column(1)], names=["lang", "words", "f"])

    return found.mapInArrow(run, "lang string, words array<string>, f long")


def phrases(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang", most: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, f) of all phrases of one to ORDER words with ``least`` occurrences, and (lang, word, n) of all words, as tables."""
    words = materialize(count_words(docs, text_col, lang_col), "words")
    known, heavy, complete = dictionary(words, least, most)
    found = spelled_out(marginals(cut_windows(windows(docs, known, heavy, complete, text_col, lang_col), least), least), known)
    return materialize(found, "phrases"), words


def _part(words: Column, first: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, least: int = 30, within: int = 80, top: int = 2000, scale: int = 2_000_000, text_col: str = "text", lang_col: str = "lang", most: int = MAX_WORDS) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut.

    Words and pieces: A-Z are lower-cased, texts are parted at punctuation and
    line ends, and pieces at blanks and tabs. A phrase of 2 to ORDER words with
    a >= ``least`` occurrences is a candidate. Cut after k words it has l and r
    occurrences of its parts and the score floor(scale * a / (l + r)); the
    lowest counts, of equals that of the smallest k. A candidate is dropped if
    a longer one that holds its words has ``within`` percent of its occurrences.

    Null texts are empty and null languages ``und``; rows that repeat count
    each; ties go by score, a and the phrase's bytes; an empty table gives no
    rows; other columns are not read. Windows of CHUNK words are held at a
    time, or those of one longer text. Products of counts are decimals.

    Returns lang, rank (from 1), phrase, a, l, r, n (the language's words),
    score.
    """
    found, words = phrases(docs, least, text_col, lang_col, most)
    counts = found.select("lang", F.array_join("words", " ").alias("part"), F.col("f").alias("part_f"))
    many = found.where(F.size("words") > 1).select("lang", "words", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"))

    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("words"), F.lit(1), F.col("k")).alias("first"), _part(F.col("words"), F.col("k") + 1, F.size("words")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("part_f").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("rest"), F.col("part_f").alias("r")), ["lang", "rest"])
    score = F.expr(f"CAST({scale} AS DECIMAL(10, 0)) * a DIV (l + r)")
    weakest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    places = [(s, m) for m in range(2, ORDER) for s in range(1, ORDER - m + 2)]
    inner = F.explode(F.filter(F.array(*(F.when(F.size("words") >= F.lit(s + m - 1), F.when(F.size("words") > m, _part(F.col("words"), s, m))) for s, m in places)), lambda p: p.isNotNull()))
    longer = many.where(F.size("words") > 2).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = weakest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < within * F.col("a"), F.lit(True)))

    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    out = materialize(out, "collocations")
    discard(found, words)
    return out
