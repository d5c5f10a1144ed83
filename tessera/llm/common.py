"""What the operators share: tables in the work folder, spans, word-wise tokenizing."""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections import ChainMap
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.shared import work_dir


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that outlives any executor. The table is removed by
    :func:`discard`, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    target, system = file_system(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def driver_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of few rows that the driver has; ``schema`` names columns and types.

    It goes into the plan as Arrow data. A list of tuples would be unpickled on
    the executors, by Python workers of a daemon of their own that stay there.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = StructType.fromDDL(schema)
    names = to_arrow_schema(kinds)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, names, strict=True)], schema=names), kinds)


#: Rows that a Python worker is given at a time, after :func:`bound_batches`.
BATCH_ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of BATCH_ROWS at most; of long texts, Spark's 10 000 take much memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that nothing reads any more."""
    for df in tables:
        target, system = file_system(df.sparkSession, df.table_path)
        system.delete(target, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Tables of so few rows are broadcast whole; of larger ones only keys that hold over 1 / HOT_KEYS of the rows, of which there are fewer than HOT_KEYS.
SMALL_ROWS, HOT_KEYS = 20_000, 1024


def is_small(df: DataFrame) -> bool:
    """Whether ``df`` has SMALL_ROWS rows at most; reads no more than that."""
    return df.select(F.lit(1)).limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def spread_join(rows: DataFrame, side: DataFrame, on: list[str], count: str, small: bool | None = None) -> DataFrame:
    """Inner join of ``rows`` with one row for each key of ``side``.

    ``count`` is the column of ``side`` with the number of rows that have the
    key. A small side (``small`` where it is known) is broadcast. Of a larger
    one the frequent keys are, under HOT_KEYS of them, so that their rows stay
    where they are; all others are shuffled. Both are then read twice. Keys
    must not be null.
    """
    if is_small(side) if small is None else small:
        return rows.join(F.broadcast(side), on)
    total = side.agg(F.sum(count)).first()[0] or 0
    hot = side.where(F.col(count) * HOT_KEYS > total)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(side.where(F.col(count) * HOT_KEYS <= total), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Table ``name`` of a data folder, pruned to ``columns`` if any are named."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts, through bounded memos of words.

    The vocabulary's pre-tokenizer never joins text across ASCII white space,
    so a text's ids are the ids of its space-separated words one after the
    other. It also parts letters from what follows them and lower-cases, so a
    plain word (Latin letters, then perhaps signs) has the ids of its letters
    and then of its signs. Arrow takes plain words apart; each distinct run of
    letters is encoded once, many at a time in one text, by the vocabulary's
    model alone; the ids that close a word tell where each ends. Words of any
    other shape are encoded by the library as they stand. A memo holds ids as
    little-endian unsigned 32-bit bytes; one that is full starts anew, that of
    words with those of the present texts, that of runs with the short ones.

    All this is tried on PROBES when a vocabulary is loaded; one for which it
    doesn't hold has ``by_words`` false, and whole texts go to the library.
    """

    PLAIN = re.compile("(?m)^(?:([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*]*)|(.*))$")

    def __init__(self, path: str, limit: int = 500_000, longest: int = 64, ids_limit: int = 250_000):
        import numpy as np
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = load_tokenizer(path)
        self.bare = Tokenizer(self.tokenizer.model)  # for runs as the model spells them
        self.bare.pre_tokenizer = WhitespaceSplit()
        split = self.tokenizer.pre_tokenizer
        self.spelling = {c: "".join(x for x, _ in split.pre_tokenize_str(c)) if split else c for c in LETTERS if not c.isascii() and c.islower()}
        self.limit, self.longest, self.ids_limit = limit, longest, min(limit, ids_limit)
        self.memo: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {"": b""}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.sizes: dict[str, int] = {"": 0}  # of words
        self.run_sizes: dict[str, int] = {"": 0}
        self.by_words = True
        self.by_words = self.many(PROBES) == list(self._whole(PROBES).values())

    def forget_sizes(self) -> None:
        """Free what counting has kept, where a worker that counted before now needs ids."""
        if len(self.sizes) > 1 or len(self.run_sizes) > 1:
            self.sizes, self.run_sizes = {"": 0}, {"": 0}

    def forget_ids(self) -> None:
        """Free what ids have been kept, where a worker that encoded before now counts."""
        if self.memo or len(self.runs) > 1:
            self.memo, self.runs = {}, {"": b""}

    def _whole(self, words: list[str]) -> dict[str, bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch(words, add_special_tokens=False)
        return {w: np.asarray(e.ids, dtype="<u4").tobytes() for w, e in zip(words, found, strict=True)}

    def _runs(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs that are one pre-token each, of letters in lower case or of signs."""
        import numpy as np

        own: dict[str, bytes] = {}
        for at in range(0, len(runs), RUNS):
            part = runs[at : at + RUNS]
            text = " ".join(part)
            spelled = text
            for c in () if text.isascii() else set(text).intersection(self.spelling):
                spelled = spelled.replace(c, self.spelling[c])
            ids = np.asarray(self.bare.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                own |= self._whole(part)
                continue
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            own.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        return own

    def _run_ids(self, runs: list[str]) -> list[bytes]:
        """Ids of distinct runs of letters or signs; the runs are kept for later."""
        found = list(map(self.runs.get, runs))
        at = [i for i, b in enumerate(found) if b is None]
        if not at:
            return found
        new = self._runs([runs[i] for i in at])
        if len(self.runs) + len(new) > self.ids_limit:
            short = {w: b for w, b in self.runs.items() if len(w) <= SHORT_RUN}  # which occur again most often
            self.runs = short if len(short) + len(new) <= self.ids_limit else {"": b""}
        self.runs.update(new)
        for i in at:
            found[i] = new[runs[i]]
        return found

    def _odd_ids(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words of other shapes; they are kept for later, but for long ones."""
        found = list(map(self.memo.get, words))
        missing = [w for w, b in zip(words, found, strict=True) if b is None]
        if not missing:
            return found
        new = self._whole(missing)
        if len(self.memo) + len(missing) > self.ids_limit:
            self.memo = {w: b for w, b in zip(words, found, strict=True) if b is not None}
        self.memo.update((w, b) for w, b in new.items() if len(w) <= self.longest)
        return [new[w] if b is None else b for w, b in zip(words, found, strict=True)]

    def _spelled(self, words):
        """Ids of distinct words (an Arrow array), as an Arrow array of bytes."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        letters, signs = pc.ascii_rtrim(words, characters=SIGNS), pc.utf8_ltrim(words, characters=LETTERS)
        n, size = pc.binary_length(letters), pc.binary_length(words)
        plain = pc.and_(pc.equal(pc.add(n, pc.binary_length(signs)), size), pc.and_(pc.greater(n, 0), pc.less_equal(size, self.longest)))
        runs = pc.utf8_lower(letters.filter(plain)).dictionary_encode()
        signs = signs.filter(plain).dictionary_encode()
        heads = pa.array(self._run_ids(strings(runs.dictionary)), pa.large_binary()).take(runs.indices)
        tails = pa.array(self._run_ids(strings(signs.dictionary)), pa.large_binary()).take(signs.indices)
        own = pc.binary_join_element_wise(heads, tails, pa.scalar(b"", pa.large_binary()))
        odd = strings(words.filter(pc.invert(plain)))
        if not odd:
            return own
        shape = plain.to_numpy(zero_copy_only=False)
        place = np.where(shape, np.cumsum(shape) - 1, len(own) + np.cumsum(~shape) - 1)
        return pa.concat_arrays([own, pa.array(self._odd_ids(odd), pa.large_binary())]).take(pa.array(place))

    def _by_word(self, texts):
        """Ids of all words of all texts, one after the other; where each word's begin, with the end of the last; each text's first word, with the end of the last.

        Texts are split by Arrow and their words numbered, so that only the
        distinct words of a call are looked up.
        """
        import numpy as np
        import pyarrow.compute as pc

        words = pc.ascii_split_whitespace(texts)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())]).astype(np.int64)
        numbered = words.flatten().dictionary_encode()
        if not len(numbered):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64), bounds
        _, ends, raw = self._spelled(numbered.dictionary).take(numbered.indices).buffers()
        ends = np.frombuffer(ends, np.int64, len(numbered) + 1) // 4
        return np.frombuffer(raw or b"", "<u4", int(ends[-1])), ends, bounds

    def arrays(self, texts):
        """Ids of all texts (a list or an Arrow array), one after the other, and where each text's begin, with the end of the last."""
        import numpy as np
        import pyarrow as pa

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_words:
            texts = texts.to_pylist()
            own = self._whole(list(set(texts)))
            parts = [own[t] for t in texts]
            return np.frombuffer(b"".join(parts), dtype="<u4"), np.cumsum([0, *(len(b) // 4 for b in parts)])
        ids, ends, bounds = self._by_word(texts)
        return ids, ends[bounds]

    def many(self, texts) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return self._cut(*self.arrays(texts))

    @staticmethod
    def _cut(ids, at) -> list[bytes]:
        raw, at = ids.tobytes(), (4 * at).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def many_and_heads(self, texts, chars: list[int]) -> tuple[list[bytes], list[int]]:
        """Both :meth:`many` and :meth:`heads` of an Arrow array; words are looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not any(chars):
            return self.many(texts), [0] * len(texts)
        whole = strings(texts)
        if not self.by_words:
            return self.many(texts), self.heads(whole, chars)
        ids, ends, bounds = self._by_word(texts)
        first = [self._whole_words(t, n) if n else "" for t, n in zip(whole, chars, strict=True)]
        own = [h.rstrip(ASCII_SPACE) for h in first]
        count = pc.list_value_length(pc.ascii_split_whitespace(pa.array(own, pa.string()))).to_numpy()
        heads = (ends[bounds[:-1] + count] - ends[bounds[:-1]]).tolist() if len(ends) > 1 else [0] * len(own)
        for i, (t, h, o) in enumerate(zip(whole, first, own, strict=True)):
            if not o:
                heads[i] = 0
            elif len(o) == len(h) and t[len(h) : len(h) + 1] not in END_OR_SPACE:  # a word that other white space ends
                heads[i] = self.heads([t], [chars[i]])[0]
        return self._cut(ids, ends[bounds]), heads

    def heads(self, texts: list[str], chars: list[int]) -> list[int]:
        """How many ids the words that start in the first ``chars`` code points of each text have."""
        if not self.by_words:
            return [len(b) // 4 for b in self.many([t[:n] for t, n in zip(texts, chars, strict=True)])]
        _, at = self.arrays([self._whole_words(t, n) if n else "" for t, n in zip(texts, chars, strict=True)])
        return [b - a for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]

    @staticmethod
    def _whole_words(text: str, chars: int) -> str:
        rest = WORD_END.search(text, chars)
        return text[:chars] if text[chars - 1 : chars].isspace() else text[: rest.start() if rest else len(text)]

    def _sizes(self, missing: list[str]) -> dict[str, int]:
        """The number of ids of each word, without keeping the ids."""
        if not missing:
            return {}
        shapes = self.PLAIN.findall("\n".join(missing).lower())
        new = {x for a, b, _ in shapes for x in (a, b)}.difference(self.run_sizes)
        if len(self.run_sizes) + len(new) > self.limit:
            self.run_sizes = {"": 0}
            new = {x for a, b, _ in shapes for x in (a, b)} - {""}
        known = self.run_sizes
        known.update((w, len(b) // 4) for w, b in self._runs(list(new)).items())
        own = {w: known[a] + known[b] for w, (a, b, _) in zip(missing, shapes, strict=True)}
        if odd := [w for w, x in zip(missing, shapes, strict=True) if x[2]]:
            own |= {w: len(b) // 4 for w, b in self._whole(odd).items()}
        return own

    def _sized(self, words: list[list[str]]) -> dict[str, int]:
        """Sizes of all the words; they are kept for later, but for odd ones."""
        if not self.by_words:
            raise ValueError("Token counts by words need a vocabulary that never joins text across white space")
        seen = set().union(*words)
        missing = seen.difference(self.sizes)
        if len(self.sizes) + len(missing) > self.limit:
            self.sizes, missing = {"": 0}, seen - {""}
        odd = [w for w in missing if len(w) > self.longest or OTHER_SPACE.search(w)]
        self.sizes.update(self._sizes(list(missing.difference(odd))))
        if not odd:
            return self.sizes
        return ChainMap(dict(zip(odd, (len(b) // 4 for b in self.many(odd)), strict=True)), self.sizes)

    def counts(self, words: list[list[str]]) -> list:
        """The number of ids of each word of each list; words hold no ASCII white space."""
        import numpy as np

        get = self._sized(words).__getitem__
        return [np.fromiter(map(get, some), dtype=np.int32, count=len(some)) for some in words]

    def totals(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        if not self.by_words:
            return [len(b) // 4 for b in self.many(texts)]
        words = [split_words(t) for t in texts]
        get = self._sized(words).__getitem__
        return [sum(map(get, some)) for some in words]


#: Letters of a run that is kept longer than others.
SHORT_RUN = 8
#: Runs that the model encodes at a time.
RUNS = 5000
#: What plain words consist of: letters with lower case forms of one letter each, then signs.
LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isalpha() and (c.islower() or len(c.lower()) == 1) and c not in "\xaa\xb5\xba")
SIGNS = ".,;:!?#$%&*"
#: White space at which Arrow splits; what follows a whole word.
ASCII_SPACE = " \t\n\x0b\x0c\r"
END_OR_SPACE = {"", *ASCII_SPACE}
#: White space to Python's split(), but not to the tokenizer.
SEPARATORS = re.compile("[\x1c-\x1f]")


#: White space to Python's split() beyond blanks, tabs and line ends.
OTHER_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PROBES = ["", "The cat, the dog.", "two  blanks\tand\n\nlines ", "don't can\u2019t 1234 5.6 x2y", "\u00dcn\u00ef,!! \u00c9*** stra\u00dfe", "a\xa0b\x0bc\x85d", "\u65e5\u672c\u8a9e \U0001f642\U0001f642 end.", LETTERS, " ".join(f"{c} x{c}" for c in LETTERS), " ".join(f"a{c} b{c}{c}" for c in SIGNS)]


WORD_END = re.compile(r"[\s\x1c-\x1f]")


def split_words(text: str) -> list[str]:
    """Words of ``text`` between runs of white space as the tokenizer knows it."""
    if SEPARATORS.search(text):
        return [w for w in re.split(r"[ \t\n\r]+", text) if w]
    return text.split()


#: The encoders of this Python worker.
ENCODERS: list[WordEncoder] = []


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks."""
    ENCODERS.append(WordEncoder(path))
    return ENCODERS[-1]


def release() -> None:
    """Give back what Arrow holds of batches that earlier tasks of this worker are done with."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def forget_words() -> None:
    """Free what tokenizing has kept, where a worker that encoded before now does something else."""
    release()
    for encoder in ENCODERS:
        encoder.forget_sizes()
        encoder.forget_ids()


def strings(texts) -> list[str]:
    """Texts of an Arrow array without nulls; ``to_pylist`` makes a scalar of each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def list_column(arrays: list, kind):
    """An Arrow list column of NumPy arrays."""
    import numpy as np
    import pyarrow as pa

    offsets = np.cumsum([0, *(len(a) for a in arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else [], kind))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


#: Spans whose places are summed at a time.
SPAN_CHUNK = 64


def regex_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern``, with their places.

    An array of structs (start, end, value): code points, end exclusive;
    ``value`` is the match's ``group``. The pattern must not match an empty
    text. The text between matches and the matches themselves add up to the
    places, so only built-in functions are needed; a text without a match is
    read once. Places are summed in chunks of SPAN_CHUNK and then over the
    chunks, so that the work grows in proportion to the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), values.alias("value"))
    # The last gap follows the last match.
    steps = F.transform(F.filter(parts, lambda x: x["match"].isNotNull()), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), x["value"].alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    none = F.array().cast("array<int>")

    def span(start: Column, end: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span(start, end, x["value"]))).alias("spans"))

    def chunks(all_: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(SPAN_CHUNK))
        return F.transform(firsts, lambda first: F.aggregate(F.slice(all_, first, SPAN_CHUNK), F.struct(F.lit(0).alias("at"), empty.alias("spans")), step))

    def placed(parts: Column) -> Column:
        before = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("before")), lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")))["before"]
        return F.flatten(F.zip_with(parts, before, lambda c, at: F.transform(c["spans"], lambda s: span(s["start"] + at, s["end"] + at, s["value"]))))

    return F.when(text.rlike(pattern), let(let(steps, chunks), placed)).otherwise(empty)
