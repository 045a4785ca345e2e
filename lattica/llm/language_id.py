"""Language identification by fusing evidence in Bayes' way.

Log posterior = tempered text likelihood + declared language + address suffix + host prior, all as log
probabilities. The text model holds hashed byte trigrams of each language, counted on a bounded sample; declared
languages and suffixes are as reliable as the whole table shows; a host's prior is smoothed towards its domain's,
and that towards the table's, from sums made by grouped aggregation over all rows.

Besides the languages there is one more class, any other language: its mean log likelihood per trigram is a floor
below that of the sample's texts of the language which fits best, as measured by models that haven't seen them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm import textvec as tv
from lattica.llm.tables import BROADCAST_ROWS, attach, digest_of, sized, without, written

LANGUAGES = ("de", "en", "es", "fr")
#: Trigrams are hashed to 2**BITS counters.
BITS = 15
#: Rows that the text model is counted on at most.
SAMPLE_ROWS = 20_000
#: Trigrams of one text are far from independent: their mean log likelihood counts as that of this many at most.
TRIGRAMS = 40
#: Share of a model's probability that is dealt evenly to all trigrams, so unseen ones weigh the same in all languages.
UNSEEN = 0.05
#: The floor of a language lies this share of the way from its own texts down to trigrams drawn evenly.
FLOOR = 0.3
#: The class of texts in none of the languages, and of texts without letters.
OTHER = "und"
#: How many rows of a host, or hosts' rows of a domain, weigh as much as the prior of the level above.
SMOOTH = 20.0


def _trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed trigram) of every three bytes in a row's text, letters only, others as one blank."""
    low = np.where(tv.NO_LETTER[data], np.uint8(32), tv.LOWER[data]).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = low[:-2] | low[1:-1] << 8 | low[2:] << 16
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    use = (row[:-2] == row[2:]) & ((low[:-2] != 32) | (low[1:-1] != 32))
    code = code[use].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return row[:-2][use], (code >> np.uint64(64 - BITS)).astype(np.int64)


class TextModel(NamedTuple):
    log: np.ndarray  # log probabilities: languages x trigrams
    floor: np.ndarray  # of each language, the mean log likelihood per trigram below which a text is in another


def _declared(b: pa.RecordBatch, languages: Sequence[str]) -> np.ndarray:
    """The index of each row's declared language, -1 for others."""
    index = {x: i for i, x in enumerate(languages)}
    return np.array([index.get(x, -1) for x in b["lang"].to_pylist()], np.int64)


def count_trigrams(batches: Iterator[pa.RecordBatch], languages: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """For each fold (0, 1) and declared language of a partition, the counts of trigrams as one array of 2**BITS numbers."""
    of_all = 2 * len(languages)
    counts = np.zeros((of_all, 1 << BITS))
    for b in batches:
        data, at = tv.buffers(b["text"])
        lang = _declared(b, languages)
        lang = np.where(lang >= 0, lang + len(languages) * np.asarray(b["fold"]), -1)
        for i, j in tv.slices(at):
            row, code = _trigrams(data[at[i] : at[j]], at[i : j + 1] - at[i])
            of = lang[i:j][row]
            weight = 1.0 / np.sqrt(np.maximum(np.bincount(row, minlength=j - i), 1))  # so that long texts don't decide alone
            counts += np.bincount(of[of >= 0] * (1 << BITS) + code[of >= 0], weight[row][of >= 0], of_all << BITS).reshape(counts.shape)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(of_all), pa.int32()), pa.array([x.astype("<f8").tobytes() for x in counts], pa.binary())], ["lang", "counts"])


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log probabilities from counts (languages x trigrams); a language without any has unseen ones only."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1e-300)
    return np.log((1 - UNSEEN) * p + UNSEEN / (1 << BITS)).astype(np.float32)


def text_model(rows: DataFrame, total: int, languages: Sequence[str] = LANGUAGES, sample_rows: int = SAMPLE_ROWS) -> TextModel:
    """The model from up to about sample_rows rows (text, lang, key), picked by key's hash.

    For the floors, the sample is halved by the texts' hash and each half scored by the other half's counts.
    """
    share = min(1.0, sample_rows / max(total, 1))
    picked = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))
    picked = picked.select("text", "lang", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"))
    found = picked.mapInArrow(lambda b: count_trigrams(b, languages), "lang int, counts binary")
    # summed by language in pandas: two groups a language of one array a partition, each of a fixed size
    summed = found.groupBy("lang").applyInPandas(_sum_counts, "lang int, counts binary").toPandas()
    counts = np.zeros((2, len(languages), 1 << BITS))
    for lang, blob in zip(summed["lang"], summed["counts"]):
        counts[divmod(lang, len(languages))] += np.frombuffer(blob, "<f8")
    held = rows.sparkSession.sparkContext.broadcast([smoothed(counts[1]), smoothed(counts[0])])
    fits = picked.mapInArrow(lambda b: own_fit(b, held.value, languages), "lang int, weight double, fit double")
    fits = fits.groupBy("lang").agg(F.sum("weight").alias("weight"), F.sum("fit").alias("fit")).collect()
    least, even = np.log(UNSEEN / (1 << BITS)), -np.log(1 << BITS)
    floor = np.full(len(languages), least)
    for r in fits:
        if r["weight"] > 0 and r["fit"] / r["weight"] > even:  # else the sample is too small to tell its own texts from others
            floor[r["lang"]] = (1 - FLOOR) * r["fit"] / r["weight"] + FLOOR * even
    return TextModel(smoothed(counts.sum(0)), floor)


def own_fit(batches: Iterator[pa.RecordBatch], models: Sequence[np.ndarray], languages: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """For each language of a partition, over the texts that are in it by declaration and by their fold's model: weight, weighted log likelihood per trigram."""
    weight, fit = np.zeros(len(languages)), np.zeros(len(languages))
    for b in batches:
        lang, fold = _declared(b, languages), np.asarray(b["fold"])
        for f, model in enumerate(models):
            use = np.flatnonzero((fold == f) & (lang >= 0))
            log, n = _likelihoods(b["text"].take(pa.array(use)), model)
            best = log.argmax(1) if len(use) else use
            same = (best == lang[use]) & (n > 0)
            much = np.minimum(n[same], TRIGRAMS)
            weight += np.bincount(best[same], much, len(languages))
            fit += np.bincount(best[same], much * log[same, best[same]], len(languages))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages)), pa.int32()), pa.array(weight), pa.array(fit)], ["lang", "weight", "fit"])


def _sum_counts(g: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << BITS)
    for blob in g["counts"]:
        total += np.frombuffer(blob, "<f8")
    return pd.DataFrame({"lang": g["lang"].iloc[:1], "counts": [total.tobytes()]})


def _likelihoods(column: pa.Array, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean log likelihoods per trigram: rows x languages, number of trigrams)."""
    data, at = tv.buffers(column)
    out, count = np.zeros((len(column), len(log))), np.zeros(len(column), np.int64)
    for i, j in tv.slices(at):
        row, code = _trigrams(data[at[i] : at[j]], at[i : j + 1] - at[i])
        n = np.bincount(row, minlength=j - i)
        count[i:j] = n
        for k in range(len(log)):
            out[i:j, k] = np.bincount(row, log[k][code], j - i) / np.maximum(n, 1)
    return out, count


def text_scores(column: pa.Array, model: TextModel) -> tuple[np.ndarray, np.ndarray]:
    """(tempered log likelihoods: rows x languages and any other, number of trigrams). A text without letters scores 0 for all."""
    mean, count = _likelihoods(column, model.log)
    other = model.floor[mean.argmax(1)] if len(mean) else np.zeros(0)
    return np.column_stack((mean, other)) * np.minimum(count, TRIGRAMS)[:, None], count


def posterior(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def suffix_of(host: Column) -> Column:
    """The part of a host after its last dot, or '' without one."""
    return F.coalesce(F.regexp_extract(host, r"\.([^.]*)$", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two parts of a host."""
    return F.coalesce(F.substring_index(host, ".", -2), F.lit(""))


def evidence(rows: DataFrame, key: str, text: Column, declared: Column, host: Column) -> DataFrame:
    """key, text, lang (declared: its part before '-', in lower case, '' if null), host, domain and suffix."""
    lang = F.lower(F.coalesce(F.regexp_extract(declared, r"^\s*([A-Za-z]+)", 1), F.lit("")))
    host = F.lower(F.coalesce(host, F.lit("")))
    return rows.select(F.col(key).alias("key"), text.alias("text"), lang.alias("lang"), host.alias("host"), domain_of(host).alias("domain"), suffix_of(host).alias("suffix"))


def _scored(rows: DataFrame, model: TextModel) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)  # languages x 2**BITS floats
    names = [f"p{i}" for i in range(len(model.log) + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            log, n = text_scores(b["text"], held.value)
            yield pa.RecordBatch.from_arrays([b["key"], b["lang"], b["host"], b["domain"], b["suffix"], pa.array(n), *(pa.array(log[:, k]) for k in range(len(names)))], ["key", "lang", "host", "domain", "suffix", "trigrams", *names])

    kind = dict(rows.dtypes)["key"]
    return rows.mapInArrow(work, f"key {kind}, lang string, host string, domain string, suffix string, trigrams long, " + ", ".join(f"{p} double" for p in names))


def identified(rows: DataFrame, key: str, text: Column, declared: Column, host: Column, least: float = 0.5, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """One row per row: key (under its own name), language, probability, text_language, declared, accepted.

    language: the likeliest by all evidence of languages (codes of two letters, as declared) and any other language,
    which is 'und', as is a text without three letters' worth of evidence; text_language: the likeliest by text alone.
    A language that the sample holds no or very few texts of can't be told from others.
    accepted: language isn't 'und' and its probability is at least least. Null declared language or host count as
    none given; null or empty text is 'und'. Of equal probabilities the first of languages is taken. Rows that repeat
    stay; no rows give none; other columns aren't looked at.
    """
    given = evidence(rows, key, text, declared, host)
    total = rows.count()
    model = text_model(given, total, languages)
    names = [*languages, OTHER]
    P = [f"p{i}" for i in range(len(names))]
    scored = written(_scored(given, model), "language-scores")
    shift = F.greatest(*P)
    weights = [F.exp(F.col(p) - shift) for p in P]
    whole = sum(weights[1:], weights[0])
    soft = scored.withColumns({f"s{i}": F.when(F.col("trigrams") > 0, w / whole).otherwise(0.0) for i, w in enumerate(weights)})
    sums = [F.sum(f"s{i}").alias(f"n{i}") for i in range(len(P))]
    # hosts, suffixes and declared languages stay tables, however many there are
    hosts = soft.groupBy("host", "domain").agg(*sums)
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(len(P))])
    everything = domains.agg(*[F.coalesce(F.sum(f"d{i}"), F.lit(0.0)).alias(f"g{i}") for i in range(len(P))]).first()
    overall = (np.array(everything, float) + 1) / (sum(everything) + len(P))
    d_all = sum((F.col(f"d{i}") for i in range(1, len(P))), F.col("d0"))
    n_all = sum((F.col(f"n{i}") for i in range(1, len(P))), F.col("n0"))
    domain_prior = [(F.col(f"d{i}") + SMOOTH * F.lit(float(overall[i]))) / (d_all + SMOOTH) for i in range(len(P))]
    hosts = hosts.join(domains, "domain")
    prior = hosts.select("host", *[F.log((F.col(f"n{i}") + SMOOTH * domain_prior[i]) / (n_all + SMOOTH)).alias(f"h{i}") for i in range(len(P))])
    prior = written(prior, "host-priors")
    log = [F.col(p) + F.col(f"h{i}") for i, p in enumerate(P)]
    joined = scored.join(sized(prior, prior.count()), "host")
    for name in ("lang", "suffix"):
        table = _log_table(soft, name, len(P))
        few = table.count() <= BROADCAST_ROWS
        joined = joined.join(F.broadcast(table), name) if few else attach(joined, table, [name], f"{name}_rows", total)
        log = [x + F.col(f"{name}{i}") for i, x in enumerate(log)]
    top = F.greatest(*log)
    mass = [F.exp(x - top) for x in log]
    p = F.lit(1.0) / sum(mass[1:], mass[0])

    def likeliest(values: list[Column]) -> Column:
        best, out = F.greatest(*values), F.lit(names[-1])
        for name, v in reversed(list(zip(names[:-1], values[:-1]))):
            out = F.when(v == best, name).otherwise(out)
        return F.when(F.col("trigrams") > 0, out).otherwise(OTHER)

    out = joined.select(F.col("key").alias(key), likeliest(log).alias("language"), p.alias("probability"), likeliest([F.col(c) for c in P]).alias("text_language"), F.col("lang").alias("declared"))
    return out.withColumn("accepted", (F.col("language") != OTHER) & (F.col("probability") >= least))


def _log_table(soft: DataFrame, name: str, classes: int) -> DataFrame:
    """Log P(value | class) of every value of a column: name, {name}_rows, {name}0, {name}1, ...

    A value that few rows have is drawn towards its share of all rows, so it tells little; a missing one tells nothing.
    """
    sums = soft.groupBy(name).agg(F.count("*").alias(f"{name}_rows"), *[F.sum(f"s{i}").alias(f"n{i}") for i in range(classes)])
    sums = written(sums, f"{name}-sums")
    whole = sums.filter(F.col(name) != "").agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0.0)) for i in range(classes)]).first()
    share = sum((F.col(f"n{i}") for i in range(1, classes)), F.col("n0")) / max(sum(whole), 1e-300)
    logs = [F.when(F.col(name) == "", 0.0).otherwise(F.log((F.col(f"n{i}") + SMOOTH * (share + 1e-9)) / (whole[i] + SMOOTH))) for i in range(classes)]
    return sums.select(name, f"{name}_rows", *[x.alias(f"{name}{i}") for i, x in enumerate(logs)])


def html_text(html: Column) -> Column:
    """A page's text: without scripts, styles, comments and tags; the commonest entities stay as they are."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return bare


def html_language(html: Column) -> Column:
    """The lang attribute of a page's html element, '' without one."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z-]+)", 1)


def kept_languages(docs: DataFrame, least: float = 0.5, host: str = "source", languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """docs, with all their columns, without those that identified() doesn't accept.

    Each row is judged by itself: rows that share a doc_id, null too, are told apart by text, language and host.
    """
    digest = digest_of(docs["text"], docs["lang"], docs[host])
    rows = docs.select(F.struct("doc_id", digest.alias("digest")).alias("row"), "text", "lang", F.col(host).alias("host"))
    found = written(identified(rows, "row", F.col("text"), F.col("lang"), F.col("host"), least, languages), "languages")
    gone = written(found.filter("not accepted").select(F.col("row.doc_id").alias("_id"), F.col("row.digest").alias("_digest")).distinct(), "rejected")
    return without(docs, gone, digest)
