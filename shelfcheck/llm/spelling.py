"""Spelling variants: words at one edit, found by search schemes on bidirectional FM-indexes of the vocabulary.

Words are maximal runs of given letters with A-Z lower-cased. Two words are near if they differ by exactly one inserted,
deleted or replaced code point. Cut a word in two halves: a word at one edit, as long or one longer, holds one of them
unchanged. So there are two searches, each exact over one half and with one error over the other; the second one runs
on reversed words. The shorter word of a pair finds the longer one, both are told.

Words that share their first (or last) code points meet in one index: how many decides the class of lengths, so that
they never reach beyond the exact half. Keys of one class are dealt to shards by hash. A key with more words than
`PIECE` is cut: every word of it asks every piece, and stands in one.

Null and empty texts hold no word. A null id counts as an empty one where spelling slips are made.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fm_index import near_words
from .tables import written

#: Letters of a word after lower-casing, slips, and what counts as a word and as a form.
LETTERS = "a-zÀ-ÿ"
SLIP_EVERY = 31
LEAST_LENGTH, LEAST_TIMES, FORM_FACTOR = 7, 2, 10

#: Words of an index (at most, for one key) and of a shard (about). Distinct words a task holds before it hands its counts on.
PIECE, SHARD, HELD = 1 << 17, 1 << 15, 200_000
#: Lengths at which a longer key begins.
STEPS = (10, 14, 20)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def slipped(run: str, id_crc: int) -> str:
    """The run, without one code point where the CRC-32 of `<id>:<run>` is a multiple of `SLIP_EVERY`."""
    h = zlib.crc32(run.encode(), id_crc)
    if h % SLIP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): words of at least `least` code points that occur `times` times or more, slips made. Counts are added up
    per task before the shuffle. Other columns are not read."""
    find = re.compile(f"[{LETTERS}]{{{least},}}").findall  # a run that is too short stays so

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()

        def told():
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                if not value.is_valid:
                    continue
                id_crc = zlib.crc32(f"{key.as_py() or ''}:".encode())
                runs = find(value.as_buffer().to_pybytes().translate(_LOWER).decode())
                for run, k in Counter(runs).items():
                    word = slipped(run, id_crc)
                    if len(word) >= least:
                        total[word] += k
                if len(total) >= HELD:
                    yield told()
        yield told()

    rows = docs.select(F.col(id_column).cast("string"), F.col(text)).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def classes(least: int) -> list[tuple[int, int | None]]:
    """Ranges of query lengths; the last is open."""
    starts = [least, *(s for s in STEPS if s > least)]
    return list(zip(starts, [*(s - 1 for s in starts[1:]), None]))


def _places(word: Column, least: int) -> Column:
    """Where a word meets others: array of (side, class, key, asks). A word stands in the class of its length; the
    shortest of a class also in the class before, where shorter words look for it."""
    size, found = F.char_length(word), []
    for k, (low, high) in enumerate(classes(least)):
        inside = (size >= low) & (size <= high + 1) if high else size >= low
        asks = size <= high if high else F.lit(True)
        for side, key in ((0, F.substring(word, 1, low // 2)), (1, F.right(word, F.lit(low - low // 2)))):
            found.append(F.when(inside, F.struct(F.lit(side).alias("side"), F.lit(k).alias("class"), key.alias("key"), asks.alias("asks"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _searched(table: pa.Table) -> pa.Table:
    reverse = table["side"][0].as_py() == 1
    words = table["word"].to_pylist()
    shown = [w[::-1] for w in words] if reverse else words
    flags = [table[c].to_numpy(zero_copy_only=False) for c in ("asks", "held")]
    half = (lambda n: n - n // 2) if reverse else (lambda n: n // 2)
    found = [[np.concatenate([q, w[more]]), np.concatenate([w, q[more]])] for q, w, more in near_words(shown, *flags, half)]
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
    word, n = (table[c].combine_chunks() for c in ("word", "n"))
    return pa.table({"word": word.take(pa.array(a)), "near": word.take(pa.array(b)), "near_n": n.take(pa.array(b))})


def near_pairs(words: DataFrame, least: int = LEAST_LENGTH, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """(word, near, near_n): every pair of near words of `words` (word, n; distinct, of `least` code points or more), both
    ways, once each."""
    if least < 2:
        raise ValueError("words of fewer than two code points can't be halved")
    # UTF-8 order of strings is the order of code points; words may be of any length.
    placed = words.select("word", "n", F.explode(_places(F.col("word"), least)).alias("p")).select("word", "n", "p.*")
    shards = max(1, -(-words.count() // shard))
    split = placed.groupBy("side", "class", "key").agg(F.ceil(F.count("*") / piece).alias("pieces")).filter("pieces > 1")
    placed = placed.join(split, ["side", "class", "key"], "left").withColumn("own", F.expr("pmod(xxhash64(word), pieces)"))
    # Whole keys share a shard by hash; a key that is cut has a shard for each piece.
    shared = placed.filter("pieces is null").select("side", "class", F.expr(f"cast(pmod(xxhash64(key), {shards}) as string)").alias("shard"), "word", "n", "asks", F.lit(True).alias("held"))
    cut = placed.filter("pieces is not null").withColumn("piece", F.explode(F.expr("sequence(0L, pieces - 1)")))
    cut = cut.withColumn("held", F.expr("own = piece")).filter("asks or held")
    cut = cut.select("side", "class", F.expr("concat(key, ' ', piece)").alias("shard"), "word", "n", "asks", "held")
    found = shared.unionByName(cut).groupBy("side", "class", "shard").applyInArrow(_searched, "word string, near string, near_n bigint")
    return found.repartition("word").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain, by doubling. A form has more occurrences than its word, so chains end."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        after = now.alias("a").join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = written(after.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def grouped(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, times: int = LEAST_TIMES, factor: int = FORM_FACTOR, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `docs`.

    form: its near word of most occurrences (of equals the first in code-point order), if it has `factor` times as many,
    else null; form_n its count. root: the word itself, or where the chain of forms ends. n_near: near words.
    """
    words = written(counted(docs, id_column, text, least, times), "spelling-words")
    pairs = near_pairs(words, least, piece, shard)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "best.near", (-F.col("best.less")).alias("near_n"))
    is_form = F.col("near_n") >= factor * F.col("n")
    known = known.select("word", F.when(is_form, F.col("near")).alias("form"), "n", "n_near", F.when(is_form, F.col("near_n")).alias("form_n"))
    known = written(known, "spelling-forms")
    ends = _roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
