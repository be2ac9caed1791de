"""Language identification by Bayesian evidence fusion.

Evidence about a text's language is combined as a product of likelihood ratios: the text itself (hashed byte
trigrams, tempered so that the trigrams of one text do not count as independent), the language that its markup
declares, and priors of its address. Address priors are hierarchical (all addresses, suffix, domain, host): each
level's counts come from one grouped aggregation of text posteriors and are smoothed towards the level above.

The trigram model is fitted on a bounded sample of labelled rows (`sample_rows`, chosen by hash of the id); text
scores, counts and priors cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import flat, materialize, slices, table, texts

BITS = 16
#: A text counts as so many independent trigrams at most.
TEMPER = 40.0
#: Strength of the level above in each level's smoothing, as a number of rows.
KAPPA = 20.0
#: Share of correct declarations in markup.
DECLARED = 0.9
#: Mean log probability of a trigram when every code is as likely: the model of no language.
FLOOR = -BITS * float(np.log(2))
#: Rows of the training sample, and bytes of a text that may be in it; a row counts whole.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 1 << 14
#: A document is kept if its language has this posterior at least.
ACCEPT = 0.5
#: Priors of at most so many addresses are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 100_000


def _fold() -> np.ndarray:
    """Lower-case ASCII letters, bytes of longer UTF-8 sequences as they are, all else a space."""
    t = np.full(256, 32, np.uint32)
    t[128:] = np.arange(128, 256)
    for c in range(97, 123):
        t[c] = t[c - 32] = c
    return t


_FOLD = _fold()


def trigrams(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash codes of the trigrams at each byte, and whether the place counts: inside one text and not in blanks."""
    if len(data) < 3:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    x = _FOLD[data]
    code = ((x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    blank = x == 32
    ok = ~(blank[:-2] & blank[1:-1]) & ~(blank[1:-1] & blank[2:])
    inner = offsets[1:-1]
    for back in (1, 2):
        cut = inner - back
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return code, ok


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  #: languages x codes, float32 log probabilities


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """docs: id, text, label. Rows without label or text, or of more than SAMPLE_BYTES, do not count; the sample is the rows of least hash of id and text."""
    rows = docs.select(F.xxhash64("id", "text").alias("h"), "text", "label").where("label IS NOT NULL AND text IS NOT NULL").where(F.octet_length("text") <= SAMPLE_BYTES)
    n = rows.count()
    if n > sample_rows:
        bound = -(2**63) + int(sample_rows / n * 2**64)
        rows = rows.where(F.col("h") <= F.lit(min(bound, 2**63 - 1)))
    got = rows.select("h", "text", "label").limit(2 * sample_rows).toArrow().combine_chunks()
    if not got.num_rows:
        return Model([], np.zeros((0, 1 << BITS), np.float32))
    labels = np.array(got.column("label").to_pylist())
    languages = sorted(set(labels.tolist()))
    counts = np.full((len(languages), 1 << BITS), 0.05)
    column = got.column("text").combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    offsets, data = flat(column)
    for i, label in enumerate(labels):
        code, ok = trigrams(np.array([0, offsets[i + 1] - offsets[i]]), data[offsets[i] : offsets[i + 1]])
        counts[languages.index(label)] += np.bincount(code[ok], minlength=1 << BITS)
    logp = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    return Model(languages, logp)


def text_scores(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """keep, then n_evidence (trigrams), fit (mean log probability under the best language), loglik (tempered, an entry a language)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    languages, logp, full = len(model.languages), model.table, docs.sparkSession.sparkContext.broadcast

    shared = full(logp)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        for part, offsets, data in slices(batches, "text"):
            code, ok = trigrams(offsets, data)
            n = np.zeros(len(code) + 3, np.int64)
            np.cumsum(ok, out=n[1 : len(code) + 1])
            n[len(code) + 1 :] = n[len(code)]
            at = np.minimum(offsets, len(code))
            count = n[at[1:]] - n[at[:-1]]
            sums = np.zeros((part.num_rows, languages))
            for k in range(languages):
                s = np.zeros(len(code) + 1)
                np.cumsum(np.where(ok, logp[k][code], 0.0), out=s[1:])
                sums[:, k] = s[at[1:]] - s[at[:-1]]
            mean = sums / np.maximum(count, 1)[:, None]
            ll = mean * np.minimum(count, TEMPER)[:, None]
            ll -= ll.max(1, keepdims=True) if languages else 0
            fit_ = np.where(count > 0, mean.max(1) if languages else 0.0, 0.0)
            flat_ll = pa.FixedSizeListArray.from_arrays(pa.array(ll.reshape(-1)), languages).cast(pa.list_(pa.float64())) if languages else pa.array([[]] * part.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(count), pa.array(fit_), flat_ll], [*keep, "n_evidence", "fit", "loglik"])

    return docs.select(*keep, "text").mapInArrow(score, f"{schema}, n_evidence long, fit double, loglik array<double>")


def _normal(logs: Column) -> Column:
    most = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - most))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _size_checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def priors(scored: DataFrame, levels: list[str], languages: list[str]) -> list[DataFrame]:
    """A table a level: its key columns (this level and those above) and prior, an array of an entry a language.

    Counts are sums of text posteriors over all rows; a level's prior is its counts plus KAPPA times the prior above.
    """
    k = len(languages)
    posterior = scored.where("n_evidence > 0").select(*levels, _normal(F.col("loglik")).alias("p"))
    total = posterior.agg(*(F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k))).first()
    n = sum(total) or 1.0
    base = [(x + 1.0) / (n + k) for x in total]
    out: list[DataFrame] = []
    above: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        keys = levels[:depth]
        sums = posterior.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col("p")[i]) for i in range(k))).alias("s"))
        parent = F.array(*(F.lit(x) for x in base))
        if above is not None:
            up = above.select(*(F.col(c).alias(f"u_{c}") for c in keys[:-1]), F.col("prior").alias("u_prior"))
            sums = sums.join(up, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in keys[:-1])), "left")
            parent = F.coalesce("u_prior", parent)
        this = sums.select(*keys, F.zip_with("s", parent, lambda s, p: (s + F.lit(KAPPA) * p) / (F.col("n") + F.lit(KAPPA))).alias("prior"))
        above = materialize(this, f"prior-{depth}", narrow=True)
        out.append(above)
    return out


def identify(docs: DataFrame, model: Model, levels: list[str], declared: str | None = None, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """docs: keys, text, the level columns and perhaps declared (null: nothing declared).

    Returns keys, lang (the most probable; ties go to the first in alphabetical order), posterior, n_evidence, accepted.
    Null, blank or letterless texts have lang null, posterior 0 and are not accepted; nor are texts whose trigrams
    fit every language worse than a uniform choice of codes would (FLOOR).
    """
    languages, k = model.languages, len(model.languages)
    if not k:
        return docs.select(*keys, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(0).cast("long").alias("n_evidence"), F.lit(False).alias("accepted"))
    keep = [*keys, *levels, *([declared] if declared else [])]
    scored = materialize(text_scores(docs, model, keep), "language-scores")
    prior = _size_checked(priors(scored, levels, languages)[-1])
    p = prior.select(*(F.col(c).alias(f"p_{c}") for c in levels), "prior")
    joined = scored.join(p, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in levels)), "left")
    logs = F.zip_with("loglik", F.coalesce("prior", F.array(*[F.lit(1.0 / k)] * k)), lambda a, b: a + F.log(b))
    if declared:
        said = F.array(*(F.when(F.col(declared) == x, F.lit(DECLARED)).when(F.col(declared).isin(*languages), F.lit((1 - DECLARED) / max(k - 1, 1))).otherwise(F.lit(1.0)) for x in languages))
        logs = F.zip_with(logs, said, lambda a, b: a + F.log(b))
    fused = joined.withColumn("post", _normal(logs)).withColumn("posterior", F.array_max("post"))
    seen = F.col("n_evidence") > 0
    lang = F.element_at(F.array(*map(F.lit, languages)), F.array_position("post", F.col("posterior")).cast("int"))
    return fused.select(
        *keys,
        F.when(seen, lang).alias("lang"),
        F.when(seen, F.col("posterior")).otherwise(0.0).alias("posterior"),
        "n_evidence",
        (seen & (F.col("fit") >= F.lit(FLOOR)) & (F.col("posterior") >= ACCEPT)).alias("accepted"),
    )


LEVELS = ["suffix", "domain", "host"]


def _address(host: Column) -> list[Column]:
    return [F.substring_index(host, ".", -1).alias("suffix"), F.substring_index(host, ".", -2).alias("domain"), host.alias("host")]


def _declared(html: Column) -> Column:
    said = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    return F.when(said != "", said).alias("declared")


def document_columns(docs: DataFrame) -> DataFrame:
    """id, rid (a hash of the text), text, declared (by markup in the text), suffix, domain and host (of `source`), and label (`lang`)."""
    return texts(docs, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("rid"), _declared(F.col("text").cast("string")), *_address(F.lower(F.col("source").cast("string"))), F.col("lang").cast("string").alias("label")).withColumnRenamed("doc_id", "id")


def _documents(docs: DataFrame) -> tuple[DataFrame, Model]:
    d = document_columns(docs)
    return d, fit(d)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents; `source` stands for the host, with its domain and suffix where it has dots. doc_id, lang, posterior, n_evidence, accepted."""
    docs, model = _documents(table(spark, sf_dir, "documents"))
    return identify(docs, model, LEVELS, "declared").withColumnRenamed("id", "doc_id")


def page_columns(pages: DataFrame) -> DataFrame:
    """id, text (html without scripts, styles, comments and tags), declared, suffix, domain and host of a pages table."""
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return pages.select(F.col("page_id").cast("long").alias("id"), plain.alias("text"), _declared(html), *_address(host))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages, with declared language and address levels; the text model is that of documents."""
    _, model = _documents(table(spark, sf_dir, "documents"))
    return identify(page_columns(table(spark, sf_dir, "pages")), model, LEVELS, "declared").withColumnRenamed("id", "page_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are accepted, with all their columns; `lang` is the language found. Rows that are equal in doc_id and text fare alike if an equal source or another suffices."""
    d, model = _documents(docs)
    found = identify(d, model, LEVELS, "declared", ("id", "rid")).where("accepted").groupBy("id", "rid").agg(F.min("lang").alias("found_"))
    rid = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    both = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"), F.col("doc_id").cast("long").alias("doc_"), rid.alias("rid_"))
    both = both.join(found, F.col("doc_").eqNullSafe(F.col("id")) & (F.col("rid_") == F.col("rid")))
    return both.select(*((F.col("found_") if c == "lang" else F.col(f"r.`{c}`")).alias(c) for c in docs.columns))
