"""Language identification by Bayesian evidence fusion.

The text gives likelihoods under byte-trigram models of the languages that the labels name, fitted on a bounded sample
of labelled rows, and under an even model of no language ("und"). Beyond that, labels are no evidence. A language with too
few labelled rows to be modelled is a candidate for the rows labelled with it, which no declaration of a modelled language
contradicts: texts say nothing for or against it, so it has the prior chance that a declaration is right. To these come the likelihoods of the declared markup
language and of the language in the address suffix, and a prior of the host. All three tables are grouped aggregations
over every row, counted by the language that the text alone suggests: the declared and suffix tables per language, the
host priors smoothed towards their domain's and those towards the whole corpus's.

Texts are never shuffled to be scored. Counts are summed in the tasks first, so a hot host is one row per task; the
host table is joined to the small rows of evidence.

Edge cases: a text without letters (null, empty, digits only) has no trigrams and is "und"; missing or unknown
declarations, suffixes and hosts are evidence for nothing; rows are judged by themselves, so repeated rows get the same
answer; without usable labels every row is "und". All pages of a document count, each as evidence of its own. Columns of
the input may have any names in keep_identified(); text_scores() and fuse() add columns that begin with li_.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import written

UND = "und"
#: Bytes as the model sees them: small letters, and every other ASCII byte as a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """Parameters of the model and of the fusion."""

    #: Labelled rows per language that the text model is fitted on, as expected number.
    sample: int = 1000
    #: A label's language is modelled if so many labelled rows, or this share of them, have it.
    least_rows: int = 50
    least_share: float = 0.01
    buckets: int = 1 << 15
    #: Neighbouring trigrams overlap: their log likelihoods count for this share.
    text_weight: float = 1 / 3
    #: Weight, in rows, of a prior against what was counted.
    prior: float = 20.0
    #: Chance that a declaration is right, before anything is counted.
    trust: float = 0.9
    #: A row is kept if the posterior of its language is at least this and the language is wanted.
    least_confidence: float = 0.5


def trigrams(text: str | None, buckets: int) -> np.ndarray:
    """Bucket numbers of the trigrams of a text that hold a letter."""
    data = np.frombuffer(b" " + (text or "").encode().translate(FOLD) + b" ", dtype=np.uint8)
    data = data[(data != 32) | np.concatenate([[True], data[:-1] != 32])].astype(np.uint32)  # one space between words
    if len(data) < 3:
        return np.zeros(0, dtype=np.uint32)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - (buckets.bit_length() - 1))


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of the buckets, by language; the last row is the even model."""

    languages: list[str]
    log_p: np.ndarray


def fit(docs: DataFrame, label: str, settings: Settings = Settings(), id_column: str = "doc_id", text: str = "text") -> TextModel:
    """The text model of the languages that column `label` names often enough.

    The sample is decided by a hash of the id; what comes to the driver is one count per language and bucket.
    """
    named = docs.groupBy(F.lower(F.col(label)).alias("lang")).count().where("lang IS NOT NULL AND lang NOT IN ('', 'und')")
    total = named.agg(F.sum("count")).first()[0] or 0
    # one row per language
    counts = {r["lang"]: r["count"] for r in named.where(F.col("count") >= min(settings.least_rows, settings.least_share * total)).collect()}
    languages = sorted(counts)
    log_p = np.full((len(languages) + 1, settings.buckets), -math.log(settings.buckets))
    if not languages:
        return TextModel(languages, log_p)
    lang = F.lower(F.col(label))
    share = F.lit(0.0)
    for k, n in counts.items():
        share = F.when(lang == k, F.lit(min(1.0, settings.sample / n))).otherwise(share)
    drawn = docs.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(id_column)), F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums.setdefault(k, np.zeros(settings.buckets, dtype=np.int64))
                sums[k] += np.bincount(trigrams(t, settings.buckets), minlength=settings.buckets)
        for k, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.record_batch([pa.array([k] * len(at)), pa.array(at), pa.array(x[at])], names=["lang", "bucket", "n"])

    found = drawn.select(lang.alias("lang"), F.col(text).cast("string")).mapInArrow(run, "lang string, bucket long, n long")
    table = found.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    for i, k in enumerate(languages):
        own = np.full(settings.buckets, 0.5)
        rows = table[table["lang"] == k]
        own[rows["bucket"].to_numpy()] += rows["n"].to_numpy()
        log_p[i] = np.log(own / own.sum())
    return TextModel(languages, log_p)


def text_scores(docs: DataFrame, model: TextModel, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """docs with li_scores: weighted log likelihoods by language and, last, of no language; null without trigrams."""
    log_p = np.ascontiguousarray(model.log_p.T.astype(np.float32))

    @F.pandas_udf("array<double>")
    def scores(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            seen = trigrams(t, settings.buckets)
            out.append(None if not len(seen) else settings.text_weight * log_p[seen].sum(axis=0, dtype=np.float64))
        return pd.Series(out)

    return docs.withColumn("li_scores", scores(F.col(text).cast("string")))


def _best(scores: Column, names: Column) -> Column:
    return F.get(names, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def _conditional(counts: dict[tuple[str, str], int], names: list[str], settings: Settings) -> dict[str, list[float]]:
    """log P(said | language) for each language, by what is said."""
    table = {}
    of = {k: sum(n for (_, best), n in counts.items() if best == k) for k in names}
    said = sorted({s for s, _ in counts} | set(names) - {UND})
    for s in said:
        row = []
        for k in names:
            before = settings.trust if s == k else (1 - settings.trust) / len(said) if k != UND else 1 / len(said)
            row.append(math.log((counts.get((s, k), 0) + settings.prior * before) / (of[k] + settings.prior)))
        table[s] = row
    return table


def _lookup(key: Column, table: dict[str, list[float]], size: int) -> Column:
    out = F.array(*[F.lit(0.0)] * size)
    for k, row in table.items():
        out = F.when(key == k, F.array(*map(F.lit, row))).otherwise(out)
    return out


def _named(c: Column | None, names: list[str]) -> Column:
    """The modelled language that c names, or null."""
    if c is None:
        return F.lit(None).cast("string")
    short = F.regexp_extract(F.lower(F.trim(c)), "^([a-z]+)", 1)
    return F.when(short.isin(*names) & (short != UND), short)


def _with_text_language(scored: DataFrame, names: list[str]) -> DataFrame:
    best = _best(F.col("li_scores"), F.array(*map(F.lit, names)))
    return scored.withColumn("li_text", F.when(F.col("li_scores").isNull(), F.lit(UND)).otherwise(best))


class _Evidence:
    """What hosts, declarations and suffixes say, from counts of li_host, li_declared, li_suffix and li_text."""

    def __init__(self, said: DataFrame, names: list[str], settings: Settings, times: str | None = None):
        n = F.count("*") if times is None else F.sum(times)
        counted = written(said.groupBy("li_host", "li_declared", "li_suffix", "li_text").agg(n.alias("n")), "language-evidence")
        self.size = len(names)

        def table(column: str) -> dict[str, list[float]]:
            rows = counted.where(F.col(column).isNotNull()).groupBy(column, "li_text").agg(F.sum("n").alias("n")).collect()  # languages squared
            return _conditional({(r[0], r[1]): r["n"] for r in rows}, names, settings)

        self.declared, self.suffix = table("li_declared"), table("li_suffix")
        # rows without a host say nothing of hosts
        of_all = {r["li_text"]: r["n"] for r in counted.where("li_host IS NOT NULL").groupBy("li_text").agg(F.sum("n").alias("n")).collect()}
        total = sum(of_all.values())
        world = [(of_all.get(k, 0) + 1) / (total + len(names)) for k in names]
        self.world = [math.log(w) for w in world]
        domain = F.regexp_extract("li_host", r"([^.]+\.)?[^.]*$", 0)
        hosts = counted.where("li_host IS NOT NULL").groupBy("li_host").agg(*(F.sum(F.when(F.col("li_text") == k, F.col("n")).otherwise(0)).alias(f"h{i}") for i, k in enumerate(names)))
        hosts = hosts.withColumn("li_domain", domain)
        domains = hosts.groupBy("li_domain").agg(*(F.sum(f"h{i}").alias(f"d{i}") for i in range(len(names))))
        a = settings.prior
        all_d, all_h = (sum((F.col(f"{c}{i}") for i in range(len(names))), F.lit(0)) for c in "dh")
        smooth = lambda i: (F.col(f"h{i}") + a * (F.col(f"d{i}") + a * world[i]) / (all_d + a)) / (all_h + a)
        #: li_host and li_prior, log chances by language.
        self.priors = hosts.join(domains, "li_domain").select("li_host", F.array(*(F.log(smooth(i)) for i in range(len(names)))).alias("li_prior"))

    def spoken(self) -> list[Column]:
        """Log likelihoods of li_declared and li_suffix."""
        return [_lookup(F.col("li_declared"), self.declared, self.size), _lookup(F.col("li_suffix"), self.suffix, self.size)]


def _plus(*arrays: Column) -> Column:
    out = arrays[0]
    for more in arrays[1:]:
        out = F.zip_with(out, more, lambda x, y: x + y)
    return out


def _judged(out: DataFrame, names: list[str], fused: Column, label: Column | None, wanted: list[str] | None, settings: Settings) -> DataFrame:
    """out with li_language, li_confidence and li_kept by the log chances `fused`; li_declared is what was declared."""
    out = out.withColumn("li_fused", _plus(F.coalesce("li_scores", F.array(*[F.lit(0.0)] * len(names))), fused))
    top = F.array_max("li_fused")
    sure = 1 / F.aggregate("li_fused", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    own = F.lit(None).cast("string") if label is None else F.nullif(F.lower(F.trim(label)), F.lit(""))
    rare = own.isNotNull() & ~own.isin(*names) & _named(own, names).isNull() & F.col("li_declared").isNull()
    language = F.when(F.col("li_scores").isNull(), F.lit(UND)).when(rare & (settings.trust >= (1 - settings.trust) * sure), own).otherwise(_best(F.col("li_fused"), F.array(*map(F.lit, names))))
    chance = F.when(rare, F.greatest(F.lit(settings.trust), (1 - settings.trust) * sure)).otherwise(sure)
    out = out.withColumns({"li_language": language, "li_confidence": F.when(F.col("li_scores").isNull(), F.lit(0.0)).otherwise(chance)})
    fits = F.col("li_language") != UND if wanted is None else F.col("li_language").isin([k for k in wanted if k != UND])
    keep = fits & (F.col("li_confidence") >= settings.least_confidence)
    return out.withColumn("li_kept", keep).drop("li_declared", "li_suffix", "li_host", "li_scores", "li_prior", "li_fused")


def fuse(
    scored: DataFrame,
    model: TextModel,
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    wanted: list[str] | None = None,
    settings: Settings = Settings(),
    label: Column | None = None,
) -> DataFrame:
    """text_scores()'s rows with li_text (by the text alone), li_language, li_confidence and li_kept.

    declared and suffix name languages; host is a name whose last two labels are its domain; label is the language
    that the row is labelled with, also one that is too rare for a model.
    """
    names = [*model.languages, UND]
    own_host = F.lit(None).cast("string") if host is None else F.lower(host)
    out = scored.withColumns({"li_declared": _named(declared, names), "li_suffix": _named(suffix, names), "li_host": F.coalesce(own_host, F.lit(""))})
    out = _with_text_language(out, names)
    evidence = _Evidence(out, names, settings)  # what every row says, by the language of its text alone
    out = out.join(evidence.priors, "li_host")
    return _judged(out, names, _plus(F.col("li_prior"), *evidence.spoken()), label, wanted, settings)


def fuse_pages(
    scored: DataFrame,
    evidence: DataFrame,
    model: TextModel,
    label: str,
    host: str,
    wanted: list[str] | None = None,
    settings: Settings = Settings(),
    id_column: str = "doc_id",
) -> DataFrame:
    """fuse() by all rows of evidence (the id column, declared, suffix, host) that a row's id has.

    The rows' log likelihoods are added, and what each one's host adds to the chances in the whole corpus. An id without
    any has its host column as its host.
    """
    names = [*model.languages, UND]
    every = range(len(names))
    # written: texts are scored once, and rows of evidence counted from the scores
    scored = written(_with_text_language(scored, names), "text-scores")
    pages = evidence.where(F.col(id_column).isNotNull()).select(id_column, _named(F.col("declared"), names).alias("li_declared"), _named(F.col("suffix"), names).alias("li_suffix"), F.lower("host").alias("li_host"))
    # partial aggregates: an id that many pages have is a few rows
    pages = written(pages.groupBy(*pages.columns).agg(F.count("*").alias("times")), "page-evidence")
    rows = scored.select(id_column, F.coalesce(F.lower(F.col(host)), F.lit("")).alias("own_host"), "li_text")
    none = F.lit(None).cast("string")
    own = rows.join(pages.select(id_column).distinct(), id_column, "left_anti").select("own_host", none, none, "li_text", F.lit(1))
    said = pages.join(rows, id_column).select("li_host", "li_declared", "li_suffix", "li_text", "times").union(own)
    known = _Evidence(said, names, settings, "times")

    nothing = F.array(*[F.lit(0.0)] * len(names))
    world = F.array(*map(F.lit, known.world))
    by_host = F.coalesce(F.zip_with("li_prior", world, lambda x, y: x - y), nothing)
    summed = pages.join(known.priors, "li_host", "left").withColumn("li_sum", _plus(by_host, *known.spoken()))
    summed = summed.groupBy(id_column).agg(F.array(*(F.sum(F.col("times") * F.col("li_sum")[i]) for i in every)).alias("li_pages"), F.max("li_declared").alias("li_declared"))
    out = scored.join(summed, id_column, "left")
    out = out.withColumns({"li_suffix": none, "li_host": F.when(F.col("li_pages").isNull(), F.coalesce(F.lower(F.col(host)), F.lit("")))})
    out = out.join(known.priors, "li_host", "left").withColumn("li_own", _plus(world, F.coalesce("li_pages", by_host)))
    return _judged(out, names, F.col("li_own"), F.col(label), wanted, settings).drop("li_pages", "li_own")


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with declared (markup language), suffix (language in the address) and host columns."""
    found = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z-]+)""", 1)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[^:]*://([^/?#:]*)", 1))
    path = F.regexp_extract(F.col(url), "^[^:]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    country = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return pages.withColumns({"declared": F.nullif(found, F.lit("")), "suffix": F.coalesce(F.nullif(path, F.lit("")), F.nullif(country, F.lit(""))), "host": host})


def keep_identified(docs: DataFrame, wanted: list[str] | None = None, settings: Settings = Settings(), id_column: str = "doc_id") -> DataFrame:
    """The rows of documents whose language is certain and wanted, with it in their lang column.

    The evidence is the text and the source; the rows' own values of lang are the labels.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("li_row"), F.col("text").cast("string").alias("li_body"), F.col("lang").alias("li_label"), F.col("source").cast("string").alias("li_source"), F.col(id_column).alias("li_id"))
    model = fit(rows, "li_label", settings, "li_id", "li_body")
    judged = fuse(text_scores(rows, model, settings, "li_body"), model, host=F.col("li_source"), wanted=wanted, settings=settings, label=F.col("li_label")).where("li_kept")
    return judged.select(*(F.col("li_language").alias(c) if c == "lang" else F.col(f"li_row.`{c}`").alias(c) for c in docs.columns))
