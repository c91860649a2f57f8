"""Language identification by language-bitmask n-gram filters.

Every language has a Bloom filter of its typical n-grams. The filters are stored bit-sliced: slot by slot, a slot
holding one bit for each language (in as many words as it takes), so that three lookups and two ANDs return all
languages that contain an n-gram.
The languages' counts over a text (popcounts by language) are corrected for the filters' false positives; the
largest decides.

N-grams are runs of 3 and of 4 UTF-8 bytes of the text in lower case, with every ASCII character that is no letter
as a blank. An n-gram is typical of a language if at least ``MIN_SHARE`` of its training documents have it and at
least ``RELATIVE`` of the share of the language where it is most frequent. Training uses every different text of each
language once, unless a caller asks for a sample.

Defined results: a null text or one without a letter is ``und`` with score 0; a text of which no n-gram is known
gets the most frequent training language with score 0; equal counts go to the language that comes first by name;
repeated rows each get a row; without training rows every text is ``und``; an empty table gives an empty table.

A text is ``foreign`` if it is in none of the languages: of its n-grams the best language's filter holds, after
correction, less than ``LEAST_KNOWN`` of the share that all but ``LOW_PART`` of that language's training documents
reach. A share of few n-grams is uncertain, so ``SPREAD`` standard deviations are granted.
Only the id and the text are read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_schema, keep_rows, narrow, per_batch, texts, type_of
from plumbline.llm.near_dup import sized
from plumbline.session import materialise

GRAMS_AT_ONCE = 4_000_000  # n-grams of documents that are summed at once
MIN_SHARE = 0.01
RELATIVE = 0.25
WORD = 64  # languages in a word of a slot
SIZES = (3, 4)
SLOT_BITS = 20
HASHES = 3
BLOCK_BYTES = 1_000_000  # bytes of text that are looked up at once
UNKNOWN = "und"
LOW_PART = 0.01  # of a language's training documents, which may be anything
LEAST_KNOWN = 0.5  # of the share of known n-grams that all others have
SPREAD = 3.0  # standard deviations that a text's own share may be off

_KEEP = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_FACTORS = np.random.default_rng(4).integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def plain(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_KEEP).split()) + b" "


def ngrams(data: np.ndarray, size: int) -> np.ndarray:
    """All runs of ``size`` bytes as numbers that also tell the size."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def slots(grams: np.ndarray) -> Iterator[np.ndarray]:
    for factor in _FACTORS:
        yield ((grams * factor) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def bits(words: np.ndarray, k: int) -> np.ndarray:
    """The bit of language ``k`` in each word or row of words."""
    column = words if words.ndim == 1 else words[:, k // WORD]
    return (column >> column.dtype.type(k % WORD)) & column.dtype.type(1)


@dataclass
class Filters:
    """The bit-sliced filters. ``wrong`` is each language's rate of false positives."""

    languages: list[str]
    sliced: np.ndarray
    wrong: np.ndarray
    most_frequent: str
    least: np.ndarray | None = None

    @staticmethod
    def build(languages: list[str], grams: np.ndarray, masks: np.ndarray, most_frequent: str) -> Filters:
        """``masks`` has a word for each n-gram, or a row of words for more languages than a word has bits."""
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        masks = masks.astype(kind).reshape(len(grams), -(-len(languages) // WORD))
        sliced = np.zeros((1 << SLOT_BITS, masks.shape[1]), kind)
        for at in slots(grams):
            for w in range(masks.shape[1]):
                np.bitwise_or.at(sliced[:, w], at, masks[:, w])
        sliced = sliced[:, 0] if masks.shape[1] == 1 else sliced
        fill = np.array([bits(sliced, k).mean() for k in range(len(languages))])
        return Filters(languages, sliced, fill**HASHES, most_frequent)

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        found = None
        for at in slots(grams):
            found = self.sliced[at] if found is None else found & self.sliced[at]
        return found

    def counts(self, values: list[bytes]) -> np.ndarray:
        """Corrected counts (texts x languages)."""
        out = np.zeros((len(values), len(self.languages)))
        portion: list[int] = []
        size = 0
        for i, value in enumerate(values):
            if portion and (size + len(value)) * -(-len(self.languages) // WORD) > BLOCK_BYTES:
                out[portion] = self.portion([values[k] for k in portion])
                portion, size = [], 0
            portion.append(i)
            size += len(value)
        if portion:
            out[portion] = self.portion([values[k] for k in portion])
        return out

    def portion(self, values: list[bytes]) -> np.ndarray:
        """Counts of some texts, laid end to end. N-grams across two texts hold a NUL, of which no filter knows."""
        line = np.frombuffer(b"\0\0\0\0".join([*values, b""]), np.uint8)
        starts = np.cumsum([0, *(len(v) + 4 for v in values)])
        total = np.zeros((len(values), len(self.languages)))
        for size in SIZES:
            found = self.lookup(ngrams(line, size))
            number = np.array([max(0, len(v) - size + 1) for v in values])
            # Rows of the running sums at the first and after the last n-gram of each text.
            for k in range(len(self.languages)):
                running = np.concatenate([[0], np.cumsum(bits(found, k), dtype=np.int64)])
                hits = running[starts[:-1] + number] - running[starts[:-1]]
                total[:, k] += (hits - self.wrong[k] * number) / (1 - self.wrong[k])
        return np.maximum(total, 0)

    def decide(self, values: list[str]) -> tuple[list[str], list[float]]:
        counts = self.counts([plain(v) for v in values])
        names, scores = [], []
        for value, row in zip(values, counts):
            if not any(map(str.isalpha, value)):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(row.argmax())
            rest = float(np.delete(row, best).max(initial=0.0))
            if row[best] <= 0:
                names.append(self.most_frequent)
                scores.append(0.0)
            else:
                names.append(self.languages[best])
                scores.append(float(row[best]) / (float(row[best]) + rest))
        return names, scores


    def known(self, values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the number of its best language, that filter's share of the n-grams, and how many these are."""
        data = [plain(v) for v in values]
        counts = self.counts(data)
        number = np.array([sum(max(0, len(v) - size + 1) for size in SIZES) for v in data])
        return counts.argmax(axis=1), np.minimum(counts.max(axis=1) / np.maximum(number, 1), 1), number

    def foreign(self, values: list[str]) -> np.ndarray:
        best, share, number = self.known(values)
        most = share + SPREAD * np.sqrt(share * (1 - share) / np.maximum(number, 1))
        letters = np.array([any(map(str.isalpha, v)) for v in values], bool)
        return ~letters | (share <= 0) | (most < self.least[best])


def gram_documents(labelled: DataFrame) -> DataFrame:
    """``lang``, ``gram`` and the number of documents that have it; many rows are summed at once."""
    schema = "lang string, gram long, n long"
    arrow = arrow_schema(labelled, schema)

    def summed(by_language: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, lists in by_language.items():
            grams, n = np.unique(np.concatenate(lists), return_counts=True)
            columns = [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_language: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch, 1)):
                data = np.frombuffer(plain(text), np.uint8)
                by_language.setdefault(lang, []).append(np.unique(np.concatenate([ngrams(data, s) for s in SIZES])))
                size += len(by_language[lang][-1])
                if size >= GRAMS_AT_ONCE:
                    yield from summed(by_language)
                    by_language, size = {}, 0
        yield from summed(by_language)

    return labelled.select("lang", "text").mapInArrow(run, schema)


def training_rows(labelled: DataFrame, lang: str, text: str, sample: int | None = None) -> tuple[DataFrame, list[str]]:
    """``lang`` and ``text`` of all different texts of each language, or of about ``sample``, and all languages. Equal texts count
    once, so that neither a text that is repeated often nor its hash decides what is learnt. Only texts that are repeated are
    shuffled."""
    given = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    given = given.withColumn("h", F.xxhash64("text"))
    hashes = materialise(given.groupBy("lang", "h").count(), "hashes")
    sizes = {r["lang"]: r["count"] for r in hashes.groupBy("lang").count().collect()}
    if not sizes:
        return given.drop("h"), []
    if sample is not None:
        spread = F.pmod(F.xxhash64("h"), F.lit(1_000_000))
        given = given.where(spread < by_name({name: 1e6 * min(1.0, sample / size) for name, size in sizes.items()}))
    repeated = sized(hashes.where("count > 1").select("lang", "h"))
    again = given.join(repeated, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    chosen = given.join(repeated, ["lang", "h"], "left_anti").unionByName(again)
    return chosen.select("lang", "text"), sorted(sizes)


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", sample: int | None = None) -> Filters | None:
    """Filters from all different texts of each language, or from about ``sample``; None without training rows.

    What comes to the driver is one row for each typical n-gram, at most the n-grams of an average document divided
    by ``MIN_SHARE`` for each language.
    """
    return fit_rows(*training_rows(labelled, lang, text, sample))


def fit_rows(chosen: DataFrame, languages: list[str]) -> Filters | None:
    """Filters from the rows and languages of ``training_rows``."""
    if not languages:
        return None
    documents = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    most = min(documents, key=lambda name: (-documents[name], name)) if documents else languages[0]
    number = -(-len(languages) // WORD)
    if not documents:
        return Filters.build(languages, np.empty(0, np.uint64), np.empty((0, number), np.uint64), most)
    share = F.col("n") / by_name(documents)
    shares = gram_documents(chosen).groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("share", share).where(F.col("share") >= MIN_SHARE)
    best = F.array_max(F.transform("found", lambda x: x.share))
    kept = F.filter("found", lambda x: x.share >= RELATIVE * best)
    typical = shares.groupBy("gram").agg(F.collect_list(F.struct("lang", "share")).alias("found"))
    rows = typical.select("gram", F.transform(kept, lambda x: F.array_position(F.lit(languages), x.lang) - 1).alias("langs")).toArrow()
    grams, langs = rows["gram"].to_numpy().astype(np.uint64), rows["langs"].combine_chunks()
    known = pc.list_flatten(langs).to_numpy(zero_copy_only=False).astype(np.uint64)
    masks = np.zeros((len(grams), number), np.uint64)
    row = np.repeat(np.arange(len(grams)), pc.list_value_length(langs).to_numpy(zero_copy_only=False).astype(np.int64))
    np.bitwise_or.at(masks, (row, (known // np.uint64(WORD)).astype(np.int64)), np.uint64(1) << known % np.uint64(WORD))
    return Filters.build(languages, grams, masks, most)


def by_name(values: dict[str, float]) -> Column:
    """The value of each row's ``lang``."""
    return F.try_element_at(F.create_map(*[F.lit(x) for name, value in values.items() for x in (name, float(value))]), F.col("lang"))


def predict(docs: DataFrame, filters: Filters | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score``: the best count's part of the two best."""
    schema = f"`{key}` {type_of(docs, key)}, lang_pred string, score double"
    own = narrow(docs, F.col(key), F.col(text))
    if filters is None:
        return own.select(key, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def work(batch: pa.RecordBatch) -> dict:
        names, scores = shared.value.decide(list(texts(batch, 1)))
        return {key: batch.column(0), "lang_pred": names, "score": scores}

    return per_batch(own, schema, work)


def with_least(filters: Filters, chosen: DataFrame) -> Filters:
    """The filters with the share of known n-grams below which a text is foreign, of each language."""
    shared = chosen.sparkSession.sparkContext.broadcast(filters)

    def work(batch: pa.RecordBatch) -> dict:
        best, share, _ = shared.value.known(list(texts(batch, 1)))
        own = [shared.value.languages[k] == name for k, name in zip(best, batch.column(0).to_pylist())]
        return {"best": best, "share": share, "own": own}

    judged = per_batch(chosen.select("lang", "text"), "best long, share double, own boolean", work).where("own and share > 0")
    low = judged.groupBy("best").agg(F.percentile_approx("share", LOW_PART, F.lit(1_000)).alias("low")).collect()
    least = np.zeros(len(filters.languages))
    for r in low:
        least[r["best"]] = LEAST_KNOWN * r["low"]
    return replace(filters, least=least)


def foreign(docs: DataFrame, train: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``key`` of the documents that are in none of the languages of the rows of ``train`` not held out."""
    filters = learnt(train, key, lang, text)
    own = narrow(docs, F.col(key), F.col(text))
    if filters is None:
        return own.select(key)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def work(batch: pa.RecordBatch) -> dict:
        return {key: batch.column(0), "foreign": shared.value.foreign(list(texts(batch, 1)))}

    return per_batch(own, f"`{key}` {type_of(docs, key)}, foreign boolean", work).where("foreign").select(key)


def learnt(train: DataFrame, key: str, lang: str, text: str) -> Filters | None:
    """The filters of the rows of ``train`` not held out, with what tells foreign texts; none without such rows."""
    chosen, languages = training_rows(train.where(~held_out(F.col(key))), lang, text)
    filters = fit_rows(chosen, languages)
    return None if filters is None else with_least(filters, chosen)


def familiar(docs: DataFrame, train: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that are not ``foreign``. Each is judged by its own text: ids may repeat or be null."""
    filters = learnt(train, key, lang, text)
    if filters is None:
        return docs.limit(0)
    shared, place = docs.sparkSession.sparkContext.broadcast(filters), docs.columns.index(text)
    return keep_rows(docs, lambda batch: [not x for x in shared.value.foreign(list(texts(batch, place)))])


def held_out(key: Column) -> Column:
    """Whether a document is kept out of training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_language(docs: DataFrame, train: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``lang_pred`` and ``score``. Filters are learnt from the rows of ``train`` not held out."""
    filters = fit(train.where(~held_out(F.col(key))), lang, text)
    return predict(docs, filters, key, text).select(key, held_out(F.col(key)).alias("held_out"), "lang_pred", "score")
