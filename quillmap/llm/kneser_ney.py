"""Quality classifier: interpolated modified Kneser-Ney model of trusted text.

The model is over character 4-grams, one for each language, with modified
Kneser-Ney discounts and interpolation down to a uniform distribution. Characters
are lower-cased code points of 16 bits, so all scripts keep their letters; white
space is one symbol and digits are another.

Counts of trusted texts are a table dealt out by (language, n-gram), and joins of
such shards give each n-gram its probability. Most n-grams of a text are among the
most frequent ones of the model: a table of at most ``MOST_SENT`` of these goes to the
tasks, which sum up their surprise. All others of every whole text are rows
(language, n-gram, document, times), joined with their backed-off probability and
summed for each document. So memory depends neither on the number of languages
nor on the corpus, and no n-gram is left out.

Counts come from all labelled trusted texts of one half of doc_ids, by a hash; quantiles
of a language's perplexity over the whole other half set its threshold. Texts are not
shuffled to meet their labels: the labelled doc_ids are bits, of which at most
``MOST_BITMAPS`` bitmaps of 32,768 doc_ids go to the tasks; where whole numbers lie so far
apart that there are more, or doc_ids are none, the texts are joined with them.

Defined results: a null or empty text has perplexity null and is not kept; a null
language is a language ``und`` of its own; a language without trusted text uses the
model and the threshold of all languages together; without any trusted text every
text that is not empty is kept; repeated rows get equal results; ``score`` passes
other columns through, its own names go first; code points beyond 16 bits share
symbols by their low bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import kernels as K
from .common import bounded, look_up, materialize

ORDER, SYMBOL_BITS = 4, 16
SYMBOLS = 1 << SYMBOL_BITS
#: Bytes of texts that are looked up at once (about): each character takes some 100 bytes on the way.
SLICE = 1 << 18
#: Most n-grams of the model that are sent to all tasks (16 bytes each).
MOST_SENT = 1 << 20
#: Most bitmaps of doc_ids that are sent to all tasks (4,096 bytes each).
MOST_BITMAPS = 2048
ANY_LANG = "*"
#: The threshold: this quantile of trusted texts' bits a symbol, a reach beyond it in distances from the median, and more for short texts (bits times the root of the length).
QUANTILE, REACH, SHORT = 0.95, 4.0, 10.0
OUT = ("model_lang", "n_symbols", "perplexity")
_CACHE: dict = {}


def symbols() -> np.ndarray:
    """The symbol of each code point: its low 16 bits, but 32 for white space and 48 for digits."""
    if "symbols" not in _CACHE:
        table = (np.arange(0x110000) % SYMBOLS).astype(np.uint64)
        table[[9, 10, 11, 12, 13, 32]] = 32
        table[48:58] = 48
        _CACHE["symbols"] = table
    return _CACHE["symbols"]


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of texts: the 4-gram code that ends at every character, and the texts' offsets. Three spaces stand before a text."""
    for _, _, buf, offsets in K.slices(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")), SLICE):
        points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        where = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
        s = symbols()[points]
        place = np.arange(len(s)) - np.repeat(where[:-1], np.diff(where))
        code = s.copy()
        for j in range(1, ORDER):
            before = np.full(len(s), 32, np.uint64)
            before[j:] = s[:-j]
            before[place < j] = 32
            code |= before << np.uint64(SYMBOL_BITS * j)
        yield code, where


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n) over rows (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = K.Tally()
        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            for name in sorted(set(names.tolist())):
                for code, _ in grams(b.column(1).filter(pa.array(names == name))):
                    tally.add(name, code)
            if tally.held > K.MOST_HELD:
                yield from tally.take()
        yield from tally.take()

    return docs.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def context_of(code: Column) -> Column:
    """An n-gram without its last symbol."""
    return F.shiftrightunsigned(code, SYMBOL_BITS)


def suffix_of(code: Column, n: int) -> Column:
    """The last n symbols."""
    return code if n >= ORDER else code.bitwiseAND(F.lit((1 << SYMBOL_BITS * n) - 1).cast("long"))


def train(trusted: DataFrame) -> dict[int, DataFrame]:
    """For each order (lang, code, p, gamma, n): the interpolated probability of an n-gram, its back-off weight as a context, and its count.

    A key of the joins has at most as many rows as there are symbols.
    """
    once = materialize(gram_counts(trusted), "counts")
    counts = {ORDER: once.unionByName(once.groupBy(F.lit(ANY_LANG).alias("lang"), "code").agg(F.sum("n").alias("n")))}
    for n in range(ORDER - 1, 0, -1):
        # lower orders count the different symbols seen before an n-gram
        counts[n] = counts[n + 1].groupBy("lang", suffix_of(F.col("code"), n).alias("code")).agg(F.count("*").alias("n"))
    model: dict[int, DataFrame] = {}
    uniform = F.lit(1.0 / SYMBOLS)
    for n in range(1, ORDER + 1):
        c = materialize(counts[n], f"order{n}")
        k = lambda i: F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double")
        of = c.groupBy("lang").agg(*[k(i).alias(f"k{i}") for i in (1, 2, 3, 4)])
        y = F.col("k1") / F.greatest(F.col("k1") + 2 * F.col("k2"), F.lit(1.0))
        d = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(float(i)), F.when(F.col(f"k{i}") > 0, i - (i + 1) * y * F.col(f"k{i + 1}") / F.col(f"k{i}")).otherwise(F.lit(0.5))))
        of = bounded(of.select("lang", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3")), "discounts")
        c = c.join(of, "lang").withColumn("cut", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        c = c.withColumn("context", context_of(F.col("code")))
        contexts = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed")).withColumn("gamma", F.col("freed") / F.col("total"))
        c = c.join(contexts, ["lang", "context"]).withColumn("own", (F.col("n") - F.col("cut")) / F.col("total"))
        weights = contexts.select("lang", F.col("context").alias("code"), "gamma")
        if n == 1:
            c = c.withColumn("p", F.col("own") + F.col("gamma") * uniform)
            model[0] = materialize(weights.withColumn("p", uniform), "model0")
        else:
            lower = model[n - 1].select("lang", F.col("code").alias("suffix"), F.col("p").alias("lower"))
            c = c.withColumn("suffix", suffix_of(F.col("code"), n - 1)).join(lower, ["lang", "suffix"], "left")
            c = c.withColumn("p", F.col("own") + F.col("gamma") * F.coalesce("lower", uniform))
            model[n - 1] = materialize(model[n - 1].drop("gamma").join(weights, ["lang", "code"], "full").select("lang", "code", "p", "gamma", "n"), f"model{n - 1}")
        model[n] = materialize(c.select("lang", "code", "p", F.lit(None).cast("double").alias("gamma"), "n"), f"model{n}")
    return model


def gram_probabilities(asked: DataFrame, model: dict[int, DataFrame]) -> DataFrame:
    """(lang, code, bits): -log2 of the probability of each distinct 4-gram of ``asked`` (lang of a model, code).

    Each order is looked up once for every different n-gram, from the shortest on.
    """
    wanted = {ORDER: asked.select("lang", "code").distinct()}
    for n in range(ORDER - 1, 0, -1):
        wanted[n] = wanted[n + 1].select("lang", suffix_of(F.col("code"), n).alias("code")).distinct()
    below = None
    for n in range(1, ORDER + 1):
        rows = wanted[n].join(model[n].select("lang", "code", F.col("p").alias("p_here")), ["lang", "code"], "left")
        rows = rows.withColumns({"context": context_of(F.col("code")), "suffix": suffix_of(F.col("code"), n - 1)})
        weight = model[n - 1].where("gamma is not null").select("lang", F.col("code").alias("context"), "gamma")
        rows = rows.join(weight, ["lang", "context"], "left")
        lower = F.lit(1.0 / SYMBOLS)
        if n > 1:
            rows, lower = rows.join(below, ["lang", "suffix"]), F.col("p_below")
        p = F.coalesce("p_here", F.coalesce("gamma", F.lit(1.0)) * lower)
        below = materialize(rows.select("lang", F.col("code").alias("suffix"), p.alias("p_below")), f"asked{n}")
    return below.select("lang", F.col("suffix").alias("code"), (-F.log2("p_below")).alias("bits"))


class Bits:
    """Bits of n-grams by (model, code): sorted mixed keys, found by their first bits."""

    def __init__(self, models: list[str], model: np.ndarray, code: np.ndarray, bits: np.ndarray) -> None:
        self.salt = {name: K.mix(np.array([i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] for i, name in enumerate(models)}
        salts = np.array([self.salt[name] for name in models], np.uint64)
        keys = K.mix(code.view(np.uint64) ^ (salts[model] if len(models) else np.uint64(0)))
        order = np.argsort(keys)
        self.keys, self.bits = keys[order], bits[order]
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(len(keys), 1))))))
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64))

    def find(self, name: str, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 if it was not sent."""
        out = np.full(len(codes), -1, np.int64)
        if name not in self.salt:
            return out
        keys = K.mix(codes ^ self.salt[name])
        bucket = (keys >> self.shift).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < end)
        while len(left):
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def frequent_grams(model: DataFrame, most: int) -> Bits:
    """The most frequent n-grams of the highest order, at most ``most``: all that have a count, as large a set as fits."""
    # different counts number at most the root of twice the trusted characters
    sizes = sorted(((r["n"], r["rows"]) for r in model.groupBy("n").agg(F.count("*").alias("rows")).collect()), reverse=True)
    least, total = None, 0
    for n, rows in sizes:
        if (total := total + rows) > most:
            break
        least = n
    t = model.where(F.col("n") >= (least if least is not None else F.lit(None))).select("lang", "code", (-F.log2("p")).alias("bits")).toArrow()
    names = t["lang"].combine_chunks().dictionary_encode() if t.num_rows else None
    models = names.dictionary.to_pylist() if t.num_rows else []
    return Bits(models, names.indices.to_numpy() if t.num_rows else np.zeros(0, np.int64), t["code"].to_numpy().astype(np.int64), t["bits"].to_numpy().astype(float))


def score(docs: DataFrame, model: dict[int, DataFrame], keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep`` columns, model_lang (null as ``und``), n_symbols and perplexity of every whole text."""
    keep = [c for c in keep if c not in OUT]
    known = bounded(model[0].select(F.col("lang").alias("_known_")).distinct(), "models")
    sent = docs.sparkSession.sparkContext.broadcast(frequent_grams(model[ORDER], MOST_SENT))
    own = [f"_{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, own, strict=True)], F.coalesce(lang, F.lit("und")).alias("_lang_"), F.col(text).alias("_text_"))
    rows = look_up(rows, known, "_lang_", "_known_").select(*own, "_lang_", F.coalesce("_known_", F.lit(ANY_LANG)).alias("_model_"), "_text_")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*own).schema), "_lang_ string, _model_ string, _row_ string, _n_ long, _bits_ double, _codes_ array<long>, _times_ array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        table, task, count = sent.value, uuid.uuid4().hex, 0
        for b in batches:
            n, bits, codes, times = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), [np.zeros(0, np.int64)] * b.num_rows, [np.zeros(0, np.int32)] * b.num_rows
            names = np.array(b.column(b.num_columns - 2).to_pylist(), object)
            for name in sorted(set(names.tolist())):
                at, done = np.flatnonzero(names == name), 0
                for code, where in grams(b.column(b.num_columns - 1).take(pa.array(at))):
                    place = table.find(name, code)
                    missing = np.flatnonzero(place < 0)
                    known = np.where(place < 0, 0.0, table.bits[place]) if len(table.bits) else np.zeros(len(place))
                    total = np.concatenate([[0.0], np.cumsum(known)])
                    cut = np.searchsorted(missing, where)
                    for i in range(len(where) - 1):
                        row = at[done + i]
                        n[row], bits[row] = where[i + 1] - where[i], total[where[i + 1]] - total[where[i]]
                        if cut[i + 1] > cut[i]:
                            found, much = np.unique(code[missing[cut[i] : cut[i + 1]]], return_counts=True)
                            codes[row], times[row] = found.view(np.int64), much.astype(np.int32)
                    done += len(where) - 1
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in codes])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, x.dtype), *part]))) for part, x in ((codes, np.zeros(0, np.int64)), (times, np.zeros(0, np.int32)))]
            ids = pa.array([f"{task}:{count + i}" for i in range(b.num_rows)])
            count += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, pa.array(n), pa.array(bits), *lists], [*b.schema.names[:-1], "_row_", "_n_", "_bits_", "_codes_", "_times_"])

    # a row's name is random, so it holds from this table on
    part = materialize(rows.mapInArrow(run, schema), "scored")
    rare = part.select("_row_", F.col("_model_").alias("lang"), F.explode(F.arrays_zip("_codes_", "_times_")).alias("g")).select("_row_", "lang", F.col("g._codes_").alias("code"), F.col("g._times_").alias("times"))
    more = rare.join(gram_probabilities(rare, model), ["lang", "code"]).groupBy("_row_").agg(F.sum(F.col("times") * F.col("bits")).alias("_more_"))
    out = part.drop("_codes_", "_times_").join(more, "_row_", "left")
    mean = (F.col("_bits_") + F.coalesce("_more_", F.lit(0.0))) / F.col("_n_")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, own, strict=True)], F.col("_lang_").alias("model_lang"), F.col("_n_").alias("n_symbols"), F.when(F.col("_n_") > 0, F.pow(F.lit(2.0), mean)).alias("perplexity"))


def judge(scored: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, reach: float = REACH, short: float = SHORT) -> DataFrame:
    """Add threshold and kept to ``scored`` by the quantiles of ``trusted``, rows of its kind. ``scored`` should be a written table.

    What is compared are bits a symbol less an allowance for short texts. A language's limit
    is its trusted texts' quantile and ``reach`` times its distance from their median.
    """
    own = F.log2("perplexity") - short / F.sqrt(F.greatest("n_symbols", F.lit(1)))
    rows = trusted.where("perplexity is not null").select("model_lang", own.alias("x"))
    limits = lambda r: r.agg(F.percentile_approx("x", F.array(F.lit(0.5), F.lit(quantile)), 10000).alias("q"))
    limit = F.col("q")[1] + reach * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.02))
    by_lang = bounded(limits(rows.groupBy("model_lang")).select(F.col("model_lang").alias("_l_"), limit.alias("_limit_")), "limits")
    of_all = bounded(limits(rows).select(limit.alias("_all_")), "limit")
    out = look_up(scored, by_lang, "model_lang", "_l_").crossJoin(of_all)
    wide = F.coalesce("_limit_", "_all_", F.lit(float("inf"))) + short / F.sqrt(F.greatest("n_symbols", F.lit(1)))
    out = out.withColumn("threshold", F.pow(F.lit(2.0), wide))
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))).drop("_l_", "_limit_", "_all_")


def fold(n: int) -> Column:
    """Whether a doc_id is in half n of the trusted ones."""
    return F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == n


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (doc_id), as a left semi join gives them."""
    if all(isinstance(t.schema["doc_id"].dataType, IntegralType) for t in (docs, ids)):
        key = F.col("doc_id").cast("long")
        bits = ids.where("doc_id is not null").groupBy(F.bitmap_bucket_number(key).alias("_bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("_bits_"))
        bits = materialize(bits, "bits")
        if bits.count() <= MOST_BITMAPS:
            at = F.bitmap_bit_position(key)
            byte = F.conv(F.hex(F.substring("_bits_", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            rows = docs.join(F.broadcast(bits), F.bitmap_bucket_number(key) == F.col("_bucket_"))
            return rows.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*docs.columns)
    return docs.join(ids, "doc_id", "left_semi")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold and kept for every document."""
    source = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    good = materialize(labels.where("quality = 1").select("doc_id").distinct(), "good")
    model = train(texts_of(source, good.where(fold(0))))
    scored = materialize(score(source, model, ["doc_id"]), "perplexities")
    out = judge(scored, scored.join(good.where(fold(1)), "doc_id", "left_semi"))
    return out.select("doc_id", F.col("model_lang").alias("lang"), "n_symbols", "perplexity", "threshold", "kept")
