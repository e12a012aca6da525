"""Text: term counts and tf-idf, ontology counts, relation closure, topics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Two or more letters, digits or underscores of any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def words_of(text: DataFrame, column: str = "text", stop: list[str] | None = None) -> DataFrame:
    """(id, w): lower-case words of two or more characters, without stop words."""
    words = F.regexp_extract_all(F.lower(F.col(column)), F.lit(TOKEN), F.lit(0))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return text.select("id", words.alias("w"))


def tokens(text: DataFrame, column: str = "text", stop: list[str] | None = None) -> DataFrame:
    """(id, terms): words, and pairs of neighbours that remain."""
    rows = words_of(text, column, stop)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return rows.select("id", F.concat("w", pairs).alias("terms"))


#: Terms that a task holds before it gives them.
TASK_TERMS = 300_000


def _terms(words: pa.ListArray) -> Iterator[list[str]]:
    """Each text's words and pairs of neighbours."""
    lengths, lo = words.value_lengths().fill_null(0).to_pylist(), 0
    values = words.flatten()
    for n in lengths:
        w = values.slice(lo, n).to_pylist()
        yield [*w, *map(" ".join, zip(w, w[1:]))]
        lo += n


def terms_of_texts(words: DataFrame) -> DataFrame:
    """(id, label, n) of each row of ``words_of``, counted where the row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, labels, n = [], [], []
            for i, own in enumerate(map(Counter, _terms(b.column("w")))):
                at += [i] * len(own)
                labels += own.keys()
                n += own.values()
                if len(labels) > TASK_TERMS or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(labels, pa.string()), pa.array(n, pa.int64())], ["id", "label", "n"])
                    at, labels, n = [], [], []

    return words.mapInArrow(run, f"id {words.schema['id'].dataType.simpleString()}, label string, n long")


def texts_of_terms(words: DataFrame) -> DataFrame:
    """(label, c): rows of ``words_of`` that have a term, summed in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for own in _terms(b.column("w")):
                total.update(set(own))
                if len(total) > TASK_TERMS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["label", "c"])
                    total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["label", "c"])

    return words.mapInArrow(run, "label string, c long").groupBy("label").agg(F.sum("c").alias("c"))


#: Most terms of a vocabulary that are sent to all tasks.
MOST_TERMS = 500_000


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt anew if it has fewer partitions than there are cores, as one small file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has at most MOST_TERMS rows."""
    return F.broadcast(df) if df.count() <= MOST_TERMS else df


def term_counts(text: DataFrame, column: str = "text", stop: list[str] | None = None, min_df: int = 50, max_df: float = 0.5) -> DataFrame:
    """(id, label, n, df, n_docs) for terms in at least ``min_df`` texts and at most a share ``max_df`` of them.

    Terms that are rare, most of them, are found in a pass of their own, so they are not shuffled for each
    text. A text's terms are counted where it is, in two passes over the texts.
    """
    words = words_of(spread(text), column, stop)
    total = text.agg(F.count("*").alias("n_docs"))
    often = checkpointed(texts_of_terms(words).where(F.col("c") >= min_df).select("label"))
    counts = terms_of_texts(words).join(small(often), "label", "left_semi").groupBy("id", "label").agg(F.sum("n").alias("n"))
    # a sum over n, not a count, so that the shuffle of the counts serves both uses
    df = counts.groupBy("label").agg(F.sum(F.least("n", F.lit(1))).cast("long").alias("df")).crossJoin(F.broadcast(total)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs")))
    return counts.join(df, "label")


def tfidf(text: DataFrame, column: str = "text", stop: list[str] | None = None, min_df: int = 50, max_df: float = 0.5) -> DataFrame:
    """Counts times smooth idf, each document of length 1."""
    counts = term_counts(text, column, stop, min_df, max_df)
    raw = counts.select("id", "label", (F.col("n") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))
    return raw.select("id", "label", (F.col("raw") / norm).alias("value"))


def substitute_words(text: DataFrame, words: dict[str, str], column: str = "text") -> DataFrame:
    """Whole words replaced by a given list; other characters stay as they are."""
    if not words:
        return text
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    parts = F.regexp_extract_all(F.col(column), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"), F.lit(0))
    return text.withColumn(column, F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(table, p), p)), ""))


def citation_keys(text: DataFrame, column: str = "text") -> DataFrame:
    """(id, key): distinct keys of \\cite, \\citep, \\citet and the like, in braces and divided by commas."""
    groups = F.regexp_extract_all(F.col(column), F.lit(r"\\cite[a-z]*\*?(?:\[[^\]]*\])*\{([^}]*)\}"), F.lit(1))
    keys = text.select("id", F.explode(groups).alias("g")).select("id", F.explode(F.split("g", ",")).alias("key"))
    return keys.select("id", F.trim("key").alias("key")).where("key <> ''").distinct()


def alias_forms(ontology: DataFrame) -> DataFrame:
    """(id, name, alias): aliases split at ", ", each also without parentheses, longest first."""
    split = ontology.select("id", "name", F.explode(F.array_union(F.array("name"), F.split(F.coalesce("alias", F.lit("")), ", "))).alias("alias")).where("alias <> ''")
    bare = F.trim(F.regexp_replace("alias", r"\s*\([^)]*\)", ""))
    both = split.select("id", "name", F.explode(F.array_distinct(F.array("alias", bare))).alias("alias")).where("alias <> ''")
    ratio = 1 - F.levenshtein("name", "alias") / F.greatest(F.length("name"), F.length("alias"))
    return both.distinct().withColumn("length", F.length("alias")).withColumn("ratio", ratio)


def ontology_rewrite(text: DataFrame, forms: DataFrame, column: str = "text") -> DataFrame:
    """(id, text): aliases replaced by their ids, longest first, so later ones see earlier replacements.

    The ontology is bounded and goes to the tasks; each text is searched for an alias
    in lower case before a replacement is tried.
    """
    import re

    rows = forms.orderBy(F.desc("length"), F.desc("ratio"), "alias").select("id", "alias").collect()
    sent = text.sparkSession.sparkContext.broadcast([(r["alias"].lower(), rf"(?i)\b{re.escape(r['alias'])}\b", r["id"]) for r in rows])

    def run(batches):
        import re

        import pyarrow as pa

        plans = [(low, re.compile(pattern), name) for low, pattern, name in sent.value]
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                t = t or ""
                low = t.lower()
                for alias, pattern, name in plans:
                    if alias in low:
                        t = pattern.sub(lambda m, name=name: name, t)
                        low = t.lower()
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["id", "text"])

    source = text.select("id", F.col(column).alias("text"))
    return source.mapInArrow(run, source.schema)


def ontology_counts(text: DataFrame, forms: DataFrame, column: str = "text") -> DataFrame:
    """(id, name, n): how often a term or one of its aliases occurs, counted on the rewritten text."""
    names = forms.select(F.col("id").alias("name")).distinct()
    found = ontology_rewrite(text, forms, column).select("id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("name"))
    return found.join(small(names), "name", "left_semi").groupBy("id", "name").agg(F.count("*").alias("n"))


def max_weights(relations: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(input, output, weight): the largest weight of any relation between two terms."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return relations.withColumn("weight", table[F.col("rel_type")]).where("weight is not null").groupBy("input", "output").agg(F.max("weight").alias("weight"))


def closure(weights: DataFrame, write=None) -> DataFrame:
    """(input, output, weight): products of weights along paths, the largest kept, at most 1, until nothing changes.

    Paths double in each round, so rounds grow with the logarithm of the longest path;
    they end, as no weight above 1 counts. ``write`` cuts the lineage of a round
    (by default a reliable checkpoint where a folder is set).
    """
    keep = write or checkpointed
    now = keep(weights.groupBy("input", "output").agg(F.least(F.max("weight"), F.lit(1.0)).alias("weight")))
    size = before = None
    while size != (size := tuple(now.agg(F.count("*"), F.sum("weight"), F.sum(F.xxhash64("input", "output", "weight").cast("decimal(38,0)"))).first())):
        if before is not None:
            before.unpersist()
        before, step = now, now.alias("a").join(now.alias("b"), F.col("a.output") == F.col("b.input")).select("a.input", "b.output", (F.col("a.weight") * F.col("b.weight")).alias("weight"))
        now = keep(now.unionByName(step).groupBy("input", "output").agg(F.least(F.max("weight"), F.lit(1.0)).alias("weight")))
    return now


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint if the session has a folder for it, else the plan as it is."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder and not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def expand_counts(counts: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, label, value): counts carried along the relations."""
    return counts.join(weights, counts["label"] == weights["input"]).groupBy("id", F.col("output").alias("label")).agg(F.sum(F.col("n") * F.col("weight")).alias("value"))


def lda(text: DataFrame, n_topics: int, column: str = "text", top: int = 3, min_df: int = 2, iterations: int = 20, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Topics by Spark ML: (topic, word, weight) and (id, topic, value). Topic names hold the top tokens."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    terms = tokens(text, column)
    n = text.count()
    counter = CountVectorizer(inputCol="terms", outputCol="features", minDF=min_df, maxDF=max(n - 2, 1)).fit(terms)
    model = LDA(k=n_topics, maxIter=iterations, seed=seed, optimizer="online").fit(counter.transform(terms))
    vocabulary = counter.vocabulary
    words = text.sparkSession.createDataFrame(list(enumerate(vocabulary)), "w int, word string")
    weights = model.describeTopics(len(vocabulary)).select(F.col("topic"), F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t"))
    weights = weights.select("topic", F.col("t.termIndices").alias("w"), F.col("t.termWeights").alias("weight")).join(words, "w").drop("w")
    best = weights.withColumn("r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "word"))).where(F.col("r") <= top)
    names = best.groupBy("topic").agg(F.concat_ws("_", F.lit(f"LDA{n_topics}_"), F.col("topic").cast("string"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), "_")).alias("name"))
    docs = model.transform(counter.transform(terms)).select("id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "value"))
    return weights.join(names, "topic"), docs.join(names, "topic")
