"""Language identification by bit-sliced Bloom filters of n-grams.

One table holds the filters of all languages: entry i, of as many words as the languages need bits, has bit l set if language
l's filter has bit i set.  So the choice of which languages know an n-gram is one conjunction of the entries at its hash positions, for all languages at once.
A document's score for a language is the share of its n-grams that the language knows, less what the filter's false positives
add; the highest decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import textvec as tv
from loomseq.llm.cluster import unused, written

UNDETERMINED = "und"
#: Letters a-z as lower case, bytes of other scripts as they are, everything else as one boundary.
FOLD = np.zeros(256, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
ASCII_LETTER = (FOLD > 0) & (FOLD < 128)
LETTER = re.compile(r"[^\W\d_]")


def grams(docs: tv.Docs, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of folded bytes (as integers) of each document, and their numbers; boundaries that follow each other are one."""
    folded = FOLD[docs.buf]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] > 0) | (folded[:-1] > 0)
    edge = docs.off[:-1][docs.off[:-1] < len(folded)]
    keep[edge] = True
    place = np.concatenate(([0], np.cumsum(keep)))[docs.off]
    folded = folded[keep].astype(np.uint64)
    count = np.maximum(np.diff(place) - size + 1, 0)
    at = np.repeat(place[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    code = np.zeros(max(0, len(folded) - size + 1), np.uint64)
    for i in range(size):
        code = (code << np.uint64(8)) | folded[i : i + len(code)]
    return code[at], count


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray
    probes: int
    size: int

    def known(self, code: np.ndarray) -> np.ndarray:
        """For each n-gram the set of languages, as bits of its row of words, whose filters hold it."""
        h = tv.mix(code)
        top = np.uint64(len(self.table) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        out = self.table[h & top]
        for _ in range(self.probes - 1):
            h = h + step
            out = out & self.table[h & top]
        return out

    def false_rates(self) -> np.ndarray:
        """For each language how often its filter holds an n-gram that isn't in it: its share of set bits to the power of probes."""
        return np.array([np.mean(self.bit(self.table, i)) for i in range(len(self.languages))]) ** self.probes

    def bit(self, sets: np.ndarray, language: int) -> np.ndarray:
        """Whether each set has the language."""
        kind = self.table.dtype.type
        word, place = divmod(language, 8 * self.table.dtype.itemsize)
        return (sets[:, word] >> kind(place)) & kind(1)


def build(languages: list[str], of: np.ndarray, code: np.ndarray, size: int, probes: int = 4, bits_each: int = 12) -> Filters:
    """Filters of the n-grams ``code``, each of language ``of``; about ``bits_each`` bits for each n-gram of the largest language."""
    kind = next((t for t in (np.uint8, np.uint16, np.uint32) if np.dtype(t).itemsize * 8 >= len(languages)), np.uint64)
    bits = np.dtype(kind).itemsize * 8
    most = int(np.bincount(of, minlength=1).max()) if len(of) else 1
    table = np.zeros((1 << max(10, (most * bits_each - 1).bit_length()), max(1, -(-len(languages) // bits))), kind)
    h = tv.mix(code)
    step = (h >> np.uint64(32)) | np.uint64(1)
    bit = (np.uint64(1) << (of % bits).astype(np.uint64)).astype(kind)
    for _ in range(probes):
        np.bitwise_or.at(table, ((h & np.uint64(len(table) - 1)).astype(np.int64), of // bits), bit)
        h = h + step
    return Filters(languages, table, probes, size)


def learn(docs: DataFrame, size: int = 4, least_share: float = 1e-5, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters from all rows with a text and a language: an n-gram belongs to a language in whose texts at least ``least_share`` of all n-grams are it.

    So a language has 1 / least_share n-grams at most, which bounds what the driver gets, and one with fewer n-grams in all its
    texts has all of them.  There may be any number of languages.  Rows without a text or language teach nothing, repeated rows
    count each; no rows give no languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column(1).dictionary_encode()
            names, of = lang.dictionary.to_pylist(), np.asarray(lang.indices)
            found: list[list[np.ndarray]] = [[] for _ in names]
            for d in tv.chunks(b.column(0)):
                code, n = grams(d, size)
                owner = np.repeat(of[d.first : d.first + len(d)], n)
                for i in range(len(names)):
                    found[i].append(code[owner == i])
            for name, codes in zip(names, found, strict=True):
                value, c = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.empty(0, np.uint64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(value), pa.string()), "code": value.astype(np.int64), "n": c.astype(np.int64)})

    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = written(rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "langid-grams")
    totals = written(counted.groupBy("lang").agg(F.sum("n").alias("total")), "langid-totals")
    languages = sorted(r["lang"] for r in totals.collect())
    kept = counted.join(totals, "lang").where(F.col("n") >= F.lit(least_share) * F.col("total")).select("lang", "code").toArrow()
    index = {x: i for i, x in enumerate(languages)}
    of = np.array([index[x] for x in kept.column("lang").to_pylist()], np.int64)
    return build(languages, of, kept.column("code").to_numpy().astype(np.uint64), size)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """All rows with lang_pred and score (0 to 1): the language's share among the corrected scores of all.

    A null text or one without a letter is ``und`` with score 0; so is every text where no language was learned.  A text whose
    n-grams no language knows, or that is shorter than one, gets the first language with score 0.  Columns named like the new
    ones are replaced.
    """
    made = ("lang_pred", "score")
    kept = [c for c in docs.columns if c.lower() not in made]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(unused(docs, "text")))
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names, false = np.array([*model.languages, UNDETERMINED], object), model.false_rates()
        for b in batches:
            best, score = [np.empty(0, np.int64)], [np.empty(0)]
            for d in tv.chunks(b.column(len(kept))):
                code, n = grams(d, model.size)
                sets = model.known(code)
                hits = np.stack([tv.per_segment(np.add, model.bit(sets, i).astype(np.int64), n, 0) for i in range(len(false))], axis=1) if len(false) else np.zeros((len(d), 0))
                right = np.maximum(hits - n[:, None] * false, 0) / np.maximum(1 - false, 1e-9)
                total = right.sum(axis=1)
                top = right.argmax(axis=1) if len(false) else np.zeros(len(d), np.int64)
                share = np.where(total > 0, right.max(axis=1, initial=0) / np.maximum(total, 1e-300), 0.0)
                plain = np.add.reduceat(np.append(ASCII_LETTER[d.buf], False), d.off[:-1].astype(np.int64), dtype=np.int64) * (np.diff(d.off) > 0)
                for i in np.flatnonzero(plain == 0):
                    if not LETTER.search(d.text(i).decode("utf-8", "replace")):
                        top[i], share[i] = len(false), 0.0
                best.append(top)
                score.append(share)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score))], names=[*kept, *made])

    return frame.mapInArrow(run, schema)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: learns from three quarters of documents, predicts all.

    A null id isn't held out; null and empty texts are ``und`` with score 0; repeated rows are predicted each.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    filters = learn(docs.where(~held))
    return predict(docs.drop("lang"), filters).select("doc_id", held.alias("held_out"), "lang_pred", "score")
