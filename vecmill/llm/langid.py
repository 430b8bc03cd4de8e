"""Language identification by Bayesian fusion of evidence.

The posterior of a page's language is proportional to

* the likelihood of its text under a byte-trigram model of the language,
* the probability of its declared language given the language, and
* a prior of its host, smoothed towards its domain, that towards its address
  suffix, and that towards all pages.

Reliability of declarations and all priors come from grouped aggregation over
all pages: sums of the posteriors that the texts alone give.  A page's own
share is taken out of its priors again, so no evidence counts twice.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import batch_rows, materialize, sized_broadcast, tidy

BUCKETS = 1 << 16
#: Rows per declared language from which the text model is fitted, about; the one bounded sample here.
TRAINING_ROWS = 3000
#: Languages up to which the text model is a table of all buckets; with more it holds the trigrams that were seen only.
DENSE = 64
#: Rows of an Arrow batch with texts.
TEXT_ROWS = 1000
#: Each byte takes part in three trigrams, so their likelihoods count a third.
TEMPER = 1 / 3
#: Weight of the wider level in a prior, in pages.
SMOOTHING = 10.0
#: The class of texts that no language explains better than random bytes do.
NONE = "und"

#: How markup begins, and where comments, scripts and styles end; what never ends is a tag up to the next ``>``, or text.
_OPEN = re.compile(r"(?ai)<(?:(!--)|(script|style)\b)?")
_CLOSE = {"!--": re.compile("-->"), "script": re.compile(r"(?ai)</script\s*>"), "style": re.compile(r"(?ai)</style\s*>")}
#: Character references too long to name a character.
_ENDLESS = re.compile(r"&#(?:[0-9]{10,}|[xX][0-9a-fA-F]{10,});?")
#: Where markup declares a language: the document's element, or a header in its place.  A tag ends at the next angle bracket, and nothing is read twice.
_VALUE = r"""\s*+=\s*+["']?+\s*+([a-z]{2,3})\b"""
_DECLARED = [rf"(?is)<html\b[^<>]*?\blang{_VALUE}", rf"(?is)<meta\b(?>[^<>]*?content-language)[^<>]*?content{_VALUE}"]
#: Letters are lower-cased and bytes beyond ASCII stay; all else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def page_text(markup: str | None) -> str:
    """Visible text of a page; one scan, whatever is left open."""
    markup = markup or ""
    out, at, endless = [], 0, set()
    while ">" not in endless and (begin := _OPEN.search(markup, at)):
        kind, end = begin[1] or (begin[2] or "").lower(), -1
        if kind and kind not in endless:
            if close := _CLOSE[kind].search(markup, begin.end()):
                end = close.end()
            else:
                endless.add(kind)
        if end < 0:
            end = markup.find(">", begin.start()) + 1
            if not end:
                endless.add(">")
                break
        out += [markup[at : begin.start()], " "]
        at = end
    return html.unescape(_ENDLESS.sub("\ufffd", "".join([*out, markup[at:]])))


def declared_language(markup: Column) -> Column:
    """Language code that the markup declares, in lower case, or null."""
    return F.lower(F.coalesce(*[F.nullif(F.regexp_extract(markup, p, 1), F.lit("")) for p in _DECLARED]))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of a text, in slices of a megabyte; runs of blanks count as one."""
    raw = b" " + b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()) + b" "
    for at in range(0, max(0, len(raw) - 2), 1 << 20):
        b = np.frombuffer(raw[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        yield ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)


Texts = Callable[[pa.RecordBatch], list[str]]


def _page_texts(batch: pa.RecordBatch) -> list[str]:
    return [page_text(x) for x in batch.column("text").to_pylist()]


def _plain_texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in batch.column("text").to_pylist()]


class Table:
    """Log probabilities of the buckets (rows) for each language."""

    def __init__(self, model: np.ndarray):
        self.model = model.astype(np.float32)

    def score(self, grams: np.ndarray) -> np.ndarray:
        return self.model[grams].sum(axis=0, dtype=np.float64)


class Seen:
    """The same for any number of languages: entries of what was seen in each, by bucket; all else follows from the bucket's share."""

    def __init__(self, bucket: np.ndarray, language: np.ndarray, n: np.ndarray, shared: np.ndarray, k: int):
        at = np.argsort(bucket, kind="stable")
        self.start = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))])
        self.language = language[at].astype(np.int32)
        self.gain = np.log1p(n[at] / (200.0 * shared[bucket[at]])).astype(np.float32)
        self.base = np.log(200.0 * shared)
        self.size = np.log(np.bincount(language, weights=n, minlength=k) + 200.0)

    def score(self, grams: np.ndarray) -> np.ndarray:
        times = np.bincount(grams, minlength=BUCKETS)
        own = np.flatnonzero(times)
        first, size = self.start[own], self.start[own + 1] - self.start[own]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        found = np.bincount(self.language[at], weights=self.gain[at] * np.repeat(times[own], size), minlength=len(self.size))
        return np.append(found + self.base[own] @ times[own] - len(grams) * self.size, -len(grams) * np.log(BUCKETS))


def fit_text_model(rows: DataFrame, texts: Texts, training_rows: int = TRAINING_ROWS) -> tuple[list[str], Table | Seen]:
    """Languages, and log probabilities of the trigram buckets for each (and for none, at the end).

    rows: ``id, text, declared``.  Fitted on about ``training_rows`` rows of each declared language,
    those with the smallest hash of their id.  What is gathered has BUCKETS rows a language at most.
    """
    sizes = {r["declared"]: r["count"] for r in rows.where("declared is not null").groupBy("declared").count().collect()}
    if not sizes:
        return [NONE], Table(np.full((BUCKETS, 1), -np.log(BUCKETS)))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, training_rows / n))])
    draw = F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where("declared is not null").where(F.coalesce(draw < F.try_element_at(share, F.col("declared")), F.lit(False)))

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column("declared").to_pylist(), texts(batch), strict=True):
                own = found.setdefault(language, np.zeros(BUCKETS, np.int64))
                for grams in trigrams(text):
                    own += np.bincount(grams, minlength=BUCKETS)
        for language, own in found.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["declared", "bucket", "n"])

    sums = sample.select("declared", "text").mapInArrow(tidy(count), "declared string, bucket long, n long").groupBy("declared", "bucket").agg(F.sum("n").alias("n"))
    with batch_rows(rows.sparkSession, TEXT_ROWS):
        sums = sums.toArrow()
    declared = sums["declared"].combine_chunks().dictionary_encode()
    if isinstance(declared, pa.ChunkedArray):
        declared = declared.combine_chunks()
    names = declared.dictionary.to_pylist()
    languages = sorted(names)
    place = {x: i for i, x in enumerate(languages)}
    at = np.array([place[x] for x in names], dtype=np.int64)[declared.indices.to_numpy()]
    bucket, n = sums["bucket"].to_numpy(), sums["n"].to_numpy()
    # Smoothed towards the trigrams of all languages, and those towards all buckets alike.
    shared = np.bincount(bucket, weights=n, minlength=BUCKETS) + 1.0
    shared /= shared.sum()
    if len(languages) > DENSE:
        return [*languages, NONE], Seen(bucket, at, n, shared, len(languages))
    counts = np.zeros((BUCKETS, len(languages) + 1))
    counts[bucket, at] = n
    counts += 200.0 * shared[:, None]
    model = np.log(counts / counts.sum(axis=0))
    model[:, -1] = -np.log(BUCKETS)
    return [*languages, NONE], Table(model)


def _posterior(scores: np.ndarray) -> np.ndarray:
    p = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def identify(rows: DataFrame, texts: Texts, training_rows: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """Language, posterior and acceptance of each row.

    rows: ``id long, text, host, domain, suffix, declared`` (nulls allowed everywhere).  Returns
    ``id, language, posterior, accepted, declared, host, n_trigrams``, one row per row.  A row is
    rejected if no language reaches ``threshold`` or none explains its text better than random bytes.
    Null and empty texts, and texts without letters, have no language: ``und``, posterior 0, rejected.
    If no row declares a language there is no model to reject by: all texts with letters are ``und``
    and accepted.  Very long texts are scored whole, in slices of a megabyte, and markup that is never
    closed costs one scan.  Repeated rows count each.  Of languages with equal posterior the first by
    its code is taken.  An empty table gives no rows; other columns, whatever their names, are not read.
    """
    languages, model = fit_text_model(rows, texts, training_rows)
    held = rows.sparkSession.sparkContext.broadcast(model)
    k = len(languages)
    keys = ["id", "host", "domain", "suffix", "declared"]

    def likelihoods(batches):
        model = held.value
        for batch in batches:
            sums, n = np.zeros((batch.num_rows, k)), np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(texts(batch)):
                for grams in trigrams(text):
                    sums[i] += model.score(grams)
                    n[i] += len(grams)
            sums *= TEMPER
            alone = _posterior(sums)
            alone[n == 0] = 0.0
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(np.round(x, 9).ravel()), k).cast(pa.list_(pa.float64())) for x in (sums, alone)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(n), *lists], [*keys, "n_trigrams", "score", "alone"])

    types = dict(rows.dtypes)
    scored = rows.mapInArrow(tidy(likelihoods), ", ".join(f"{c} {types[c]}" for c in keys) + ", n_trigrams long, score array<double>, alone array<double>")
    with batch_rows(rows.sparkSession, TEXT_ROWS):
        scored = materialize(scored, "likelihoods")

    def sums(key: str) -> DataFrame:
        each = [F.sum(F.col("alone")[i]) for i in range(k)]
        return scored.groupBy(F.col(key).alias(key)).agg(F.array(*each).alias(f"{key}_sum"))

    def level(df: DataFrame, key: str) -> DataFrame:
        # Null-safe: pages without a host form one.
        other = sized_broadcast(sums(key), 1 << 16).withColumnRenamed(key, "_key")
        return df.join(other, df[key].eqNullSafe(F.col("_key")), "left").drop("_key")

    # One row per host carries the sums of all wider levels, so the pages are joined once.
    hosts = level(level(scored.groupBy("host", "domain", "suffix").agg(F.array(*[F.sum(F.col("alone")[i]) for i in range(k)]).alias("host_sum")), "domain"), "suffix")
    hosts = sized_broadcast(hosts, 1 << 16)
    same = [scored[c].eqNullSafe(hosts[c]) for c in ("host", "domain", "suffix")]
    pages = scored.join(hosts, same[0] & same[1] & same[2]).select(scored["*"], "host_sum", "domain_sum", "suffix_sum")

    # All pages, and the pages of each declared code.
    totals = lambda: F.array(*[F.coalesce(F.sum(F.col("alone")[i]), F.lit(0.0)) for i in range(k)])
    whole_sum = np.array(scored.agg(totals().alias("s")).first()["s"])
    codes = materialize(scored.where("declared is not null").groupBy(F.col("declared").alias("_code")).agg(totals().alias("code_sum")), "codes")
    n_codes = codes.count()
    pages = pages.join(sized_broadcast(codes, 1 << 16), pages["declared"] == F.col("_code"), "left").drop("_code")

    def fuse(batches):
        usual = whole_sum + 0.5 * (n_codes + 1)
        for batch in batches:
            table = lambda c: np.array(batch.column(c).flatten()).reshape(batch.num_rows, k)
            alone, score = table("alone"), table("score")
            prior = np.full((batch.num_rows, k), 1.0 / k)
            for sum_ in (whole_sum[None, :], table("suffix_sum"), table("domain_sum"), table("host_sum")):
                others = np.maximum(sum_ - alone, 0.0)
                prior = (others + SMOOTHING * prior) / (others.sum(axis=1, keepdims=True) + SMOOTHING)
            # P(declared code | language), smoothed; no declaration tells nothing.
            given = np.asarray(batch.column("declared").is_valid())
            said = np.zeros((batch.num_rows, k))
            said[given] = np.log((np.array(batch.column("code_sum").filter(pa.array(given)).flatten()).reshape(-1, k) + 0.5) / usual)
            p = _posterior(score + np.log(prior) + said)
            best = p.argmax(axis=1)
            n = batch.column("n_trigrams").to_numpy()
            top = np.where(n > 0, np.round(p[np.arange(len(best)), best], 6), 0.0)
            names = [languages[b] if m else NONE for b, m in zip(best, n, strict=True)]
            ok = pa.array([bool(m) and (k == 1 or (x != NONE and t >= threshold)) for x, t, m in zip(names, top, n, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(top), ok, *[batch.column(c) for c in ("declared", "host", "n_trigrams")]], ["id", "language", "posterior", "accepted", "declared", "host", "n_trigrams"])

    return pages.mapInArrow(tidy(fuse), f"id {types['id']}, language string, posterior double, accepted boolean, declared string, host string, n_trigrams long")


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^.*?://([^/?#:]*)", 1))


def _address(host: Column) -> list[Column]:
    host = F.when(host == "", None).otherwise(host)
    return [host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.substring_index(host, ".", -1).alias("suffix")]


def identify_pages(pages: DataFrame, training_rows: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """``identify`` for raw pages (``page_id, url, html``); the id column is page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("html").cast("string").alias("text"), *_address(_host(F.col("url"))), declared_language(F.col("html")).alias("declared"))
    return identify(rows, _page_texts, training_rows, threshold).withColumnRenamed("id", "page_id")


def identify_documents(docs: DataFrame, training_rows: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """``identify`` for documents (``doc_id, text, lang, source``): lang is what is declared, source the host."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), *_address(F.col("source").cast("string")), F.col("lang").cast("string").alias("declared"))
    return identify(rows, _plain_texts, training_rows, threshold).withColumnRenamed("id", "doc_id")


def accepted_documents(docs: DataFrame, training_rows: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """The documents whose language is identified, unchanged.

    Each row is judged by itself, with or without a doc_id; rows that agree in doc_id, text, lang and
    source have one verdict.  Other columns pass through; an empty table gives none.
    """
    own = [F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("text", "lang", "source")]]
    key = F.xxhash64(*own, *[c.isNull() for c in own])
    found = identify_documents(docs.select(key.alias("doc_id"), "text", "lang", "source"), training_rows, threshold)
    gone = sized_broadcast(found.where("not accepted").select(F.col("doc_id").alias("_key")).distinct())
    whole = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"))
    return whole.join(gone, F.col("key") == F.col("_key"), "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
