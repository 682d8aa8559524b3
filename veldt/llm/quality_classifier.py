"""Quality classifier: text evidence of each document combined with posteriors of its host and path.

A logistic model on word presence and style is fitted on a bounded sample of the labelled documents and scores every
document. Grouped sums of those scores give each host, and each path in it, a posterior by empirical Bayes: sparse
paths shrink toward their host, sparse hosts toward the global mean, with prior strengths estimated from the spread
between hosts and between paths. A document's log-odds are moved by the posterior that its path has without the document,
which is taken out of the path's and of the host's sums; one that stands at several sites counts at each of them and is
moved by the mean over all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm import words as W
from veldt.llm.common import WORD_SLICE_BYTES, discard, fresh, materialize, small, text_slices
from veldt.llm.quality_rules import _IS_SYMBOL, _repeated_words, _sums

#: The fit reads at most about so many labelled documents; features that each of the two models may have.
SAMPLE_DOCS = 20_000
MODEL_FEATURES = 384
#: Documents that must have a feature, hash buckets of features (2 to this power), bytes of a word's prefix feature.
LEAST_DOCS, FEATURE_BITS, PREFIX_BYTES = 5, 24, 4
#: The most that a site moves a document's log-odds by default; bounds of the prior strengths, in documents.
SITE_SHIFT = 2.0
STRENGTH = (2.0, 1000.0)
STYLE = ("log words", "symbols a word", "repeated words", "distinct words", "bytes a word", "blank-free digits", "words of one byte")

_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?'\"()")] = True
_DIGIT = np.zeros(256, np.int64)
_DIGIT[list(b"0123456789")] = 1


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a run of documents: document and bucket of each word and word prefix, and the style row of each document."""
    starts, ends, first = W.word_bounds(data, offsets)
    n = len(offsets) - 1
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    lower = W._LOWER[data]
    prefix = W.prefix_hashes(lower)
    bare = ends.copy()
    for _ in range(2):  # stops at the end of words
        bare -= ((bare - starts) > 1) & _STOP[data[np.maximum(bare - 1, 0)]]
    word = W.mix(W.substring_hashes(prefix, starts, bare) + (bare - starts).astype(np.uint64))
    long = np.flatnonzero(bare - starts > PREFIX_BYTES)
    head = W.mix(W.substring_hashes(prefix, starts[long], starts[long] + PREFIX_BYTES) ^ np.uint64(0x5DEECE66D))
    shift = np.uint64(64 - FEATURE_BITS)
    docs = np.concatenate([doc, doc[long]])
    buckets = np.concatenate([word >> shift, head >> shift]).astype(np.int64)
    raw = W.word_hashes(data, starts, ends)
    # distinct words of a document: the first of each run of equal keys, counted back by document
    keyed = W.mix(raw + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(keyed)
    new = np.ones(len(order), bool)
    new[1:] = keyed[order[1:]] != keyed[order[:-1]]
    distinct = np.bincount(doc[order[new]], minlength=n)
    each = np.maximum(n_words, 1)
    style = np.stack([
        np.log1p(n_words), np.minimum(_sums(_IS_SYMBOL[data], offsets) / each, 4), _repeated_words(raw, first) / each, distinct / each,
        np.minimum(np.diff(offsets) / each, 30), np.minimum(_sums(_DIGIT[data], offsets) / each, 4), _sums((ends - starts == 1).astype(np.int64), first) / each,
    ], 1)
    return docs, buckets, style


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, offsets in text_slices(batch, 0, WORD_SLICE_BYTES):
            docs, buckets, style = _features(data, offsets)
            pairs = np.unique(docs.astype(np.int64) << FEATURE_BITS | buckets)
            cuts = np.searchsorted(pairs >> FEATURE_BITS, np.arange(end - at + 1))
            values = pairs & ((1 << FEATURE_BITS) - 1)
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int64()))
            styles = pa.array(list(style), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(at, end - at) for k in (1, 2, 3)], lists, styles], names=["id", "bad", "toxic", "features", "style"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps with a ridge penalty on all but the intercept."""
    w = np.zeros(x.shape[1] + 1)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        gradient, hessian = penalty * w, np.diag(penalty)
        for at in range(0, len(x), 2048):  # by blocks, so that the driver holds the rows once
            some = np.hstack([x[at : at + 2048], np.ones((len(x[at : at + 2048]), 1))])
            p = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
            gradient += some.T @ (p - y[at : at + 2048])
            hessian += (some * (p * (1 - p) + 1e-6)[:, None]).T @ some
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, features: int = MODEL_FEATURES) -> dict[str, np.ndarray]:
    """Models of 'bad' (quality 0) and 'toxic' from labels (id_col, quality, toxic): buckets, weights, style scale.

    The fit reads about sample_docs labelled ids, drawn by hash, and of each id one row, so it is bounded. Several labels of a document are averaged. Without labelled documents of both kinds, a model says no of all.
    """
    marked = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].cast("long").alias("label_id")).agg((F.avg("quality") < 0.5).cast("int").alias("bad"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    n = marked.count()
    drawn = (F.pmod(F.xxhash64("label_id"), F.lit(1 << 30)) / float(1 << 30)) < sample_docs / max(n, 1)
    sample = materialize(marked.where(drawn))
    joined = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), docs[id_col].cast("long").alias("label_id")).join(small(sample, sample.count()), "label_id")
    joined = joined.groupBy("label_id", "bad", "toxic").agg(F.max(F.coalesce("t", F.lit(""))).alias("t"))
    rows = materialize(joined.select("t", "label_id", "bad", "toxic").mapInArrow(_sample_rows, "id long, bad int, toxic int, features array<long>, style array<double>"))
    heads = ("bad", "toxic")
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).alias(h) for h in heads]).first()
    counts = rows.select(*heads, F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(h) for h in heads]).where(F.col("n") >= LEAST_DOCS)
    chosen: dict[str, list[int]] = {}
    for h in heads:
        rate = total[h] / max(total["n"], 1)
        z = F.abs(F.col(h) - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate * (1 - rate), 1e-9))
        chosen[h] = sorted(r["f"] for r in counts.orderBy(z.desc(), "f").limit(features).select("f").collect()) if 0 < rate < 1 else []
    every = sorted({*chosen["bad"], *chosen["toxic"]})
    wanted = F.array(*[F.lit(f).cast("long") for f in every]) if every else F.array().cast("array<long>")
    local = rows.select(*heads, F.array_intersect("features", wanted).alias("f"), "style").toPandas()
    discard(rows, sample)
    style = np.stack(local["style"].to_numpy()) if len(local) else np.zeros((0, len(STYLE)))
    mean, scale = (style.mean(0), style.std(0) + 1e-9) if len(local) else (np.zeros(len(STYLE)), np.ones(len(STYLE)))
    model: dict[str, np.ndarray] = {"buckets": np.array(every, np.int64), "mean": mean, "scale": scale}
    x = np.zeros((len(local), len(every) + len(STYLE)), np.float32)
    for i, some in enumerate(local["f"]):
        x[i, np.searchsorted(model["buckets"], np.asarray(some, np.int64))] = 1
    x[:, len(every) :] = (style - mean) / scale
    for h in heads:
        if not chosen[h]:
            model[h] = np.concatenate([np.zeros(x.shape[1]), [-30.0]])
            continue
        own = np.concatenate([np.isin(model["buckets"], chosen[h]), np.ones(len(STYLE), bool)])
        weights = np.zeros(x.shape[1] + 1)
        weights[np.append(own, True)] = fit_logistic(x[:, own], local[h].to_numpy(np.float64))
        model[h] = weights
    return model


def _scorer(model: dict[str, np.ndarray], others: list[str], names: list[str]):
    buckets, n_features = model["buckets"], len(model["buckets"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_slices(batch, 0, WORD_SLICE_BYTES):
                docs, found, style = _features(data, offsets)
                style = (style - model["mean"]) / model["scale"]
                logits = []
                if n_features:
                    place = np.minimum(np.searchsorted(buckets, found), n_features - 1)
                    hit = buckets[place] == found
                    pairs = np.unique(docs[hit].astype(np.int64) * n_features + place[hit])
                else:
                    pairs = np.zeros(0, np.int64)
                for h in ("bad", "toxic"):
                    w = model[h]
                    own = np.bincount(pairs // max(n_features, 1), weights=w[:n_features][pairs % max(n_features, 1)] if len(pairs) else None, minlength=end - at)
                    logits.append(pa.array(np.clip(own + style @ w[n_features:-1] + w[-1], -30, 30), pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(k + 1).slice(at, end - at) for k in range(len(others))], *logits], names=[*others, *names])

    return score


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(safe / (1 - safe))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def site_posteriors(scores: DataFrame, p: str) -> DataFrame:
    """Rows of host, path with n and total, host_n, host_total, host_strength, host_mean (the host's posterior), strength
    (of the path's prior) and global_mean.

    scores has host, path and a probability p. Prior strengths are those of a beta prior with the variance between
    groups that is left after the variance within: mean (1 - mean) / variance - 1, within STRENGTH.
    """
    paths = scores.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("total"), F.sum(F.col(p) * F.col(p)).alias("squares"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"), F.sum("squares").alias("host_squares"))
    whole = hosts.agg((F.sum("host_total") / F.sum("host_n")).alias("global_mean"))

    def strength(groups: DataFrame, n: Column, total: Column, squares: Column, center: Column) -> Column:
        within = F.sum(squares - total * total / n) / F.greatest(F.sum(n) - F.count(F.lit(1)), F.lit(1))
        between = F.sum(n * (total / n - center) * (total / n - center)) - within * F.count(F.lit(1))
        tau = F.greatest(between / F.sum(n), F.lit(1e-9))
        mean = F.first("global_mean")
        return F.least(F.greatest(mean * (1 - mean) / tau - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))

    hosts = hosts.crossJoin(F.broadcast(whole))  # one row
    k_host = hosts.agg(strength(hosts, F.col("host_n"), F.col("host_total"), F.col("host_squares"), F.col("global_mean")).alias("host_strength"))
    hosts = hosts.crossJoin(F.broadcast(k_host)).withColumn("host_mean", (F.col("host_total") + F.col("host_strength") * F.col("global_mean")) / (F.col("host_n") + F.col("host_strength")))
    joined = paths.join(hosts.select("host", "host_mean", "host_n", "host_total", "host_strength", "global_mean"), "host")
    k_path = joined.agg(strength(joined, F.col("n"), F.col("total"), F.col("squares"), F.col("host_total") / F.col("host_n")).alias("strength"))
    return joined.crossJoin(F.broadcast(k_path)).select("host", "path", "n", "total", "host_n", "host_total", "host_strength", "host_mean", "strength", "global_mean")


def classify(
    docs: DataFrame, labels: DataFrame, sites: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", host_cols: tuple[str, ...] = ("source",), path_cols: tuple[str, ...] = ("source", "lang"),
    sample_docs: int = SAMPLE_DOCS, threshold: float = 0.5, site_shift: float = SITE_SHIFT, keep_text: bool = False,
) -> DataFrame:
    """docs (without text_col, but with keep_text) with host, path, bad_score, toxic_score (posterior probabilities) and kept.

    sites (id_col, host, path) gives documents their site; those without one have host_cols and path_cols for it. A
    document is kept if both scores are at most the threshold; its sites move its log-odds by at most site_shift. Null texts are empty; null ids have no label and no site;
    null hosts and paths are groups of their own; repeated rows count each. Each distinct site of an id counts in the
    posteriors, and the document is moved by the mean of what each of its sites moves it; the host and path shown are the
    least. An empty table gives an empty table; extra columns pass through. Groups are added up before they are shuffled,
    so a hot host costs no more than others; posteriors are joined by broadcast where they were counted to be few.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, sample_docs=sample_docs)
    others = [c for c in docs.columns if keep_text or c != text_col]
    bad_l, toxic_l, sid, host, path, bad, toxic, kept, key, row, moved, scored_text, times, own_id, own_site = fresh(
        docs.select(*[f"`{c}`" for c in others]), "bad_logit", "toxic_logit", "site_id", "host", "path", "bad_score", "toxic_score", "kept", "site_key", "site_row", "moved_row", "scored_text", "site_times", "site_own_id", "site_own"
    )
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others], f"`{bad_l}` double", f"`{toxic_l}` double"])
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias(scored_text), *[f"`{c}`" for c in others])
    scored = materialize(source.mapInArrow(_scorer(model, others, [bad_l, toxic_l]), schema).withColumn(row, F.monotonically_increasing_id()))
    named = lambda cols: F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols if c in others]) if any(c in others for c in cols) else F.lit("")
    site = lambda h, p: F.struct(h.alias("h"), p.alias("p"))
    # Sites are joined to rows without their text, which is moved once, in the end.
    placed = scored.select(row, F.col(f"`{id_col}`").cast("long").alias(own_id), bad_l, toxic_l, F.array(site(named(host_cols), named(path_cols))).alias(own_site))
    if sites is None:
        placed = placed.withColumn(key, F.col(own_site))
    else:
        shown = sites.where(sites[id_col].isNotNull()).select(sites[id_col].cast("long").alias(sid), site(F.coalesce(sites["host"], F.lit("")), F.coalesce(sites["path"], F.lit(""))).alias(key))
        every = shown.distinct().groupBy(sid).agg(F.sort_array(F.collect_list(key)).alias(key))
        every = every.withColumn(key, F.transform(key, lambda s: site(s["h"], F.concat_ws("/", s["h"], s["p"]))))
        placed = placed.join(every, F.col(own_id) == F.col(sid), "left").withColumn(key, F.coalesce(key, own_site))
    placed = materialize(placed.select(row, bad_l, toxic_l, key))
    moves = placed.select(F.col(row).alias(moved), bad_l, toxic_l, key, F.explode(key).alias("s"))
    in_host = F.size(F.filter(key, lambda x: x["h"] == F.col("s.h")))  # how often the host's sums hold the document
    moves = moves.select(moved, bad_l, toxic_l, in_host.alias(times), F.col("s.h").alias(host), F.col("s.p").alias(path))
    seen = moves
    for logit, score in ((bad_l, bad), (toxic_l, toxic)):
        table = materialize(site_posteriors(seen.select(F.col(host).alias("host"), F.col(path).alias("path"), _sigmoid(F.col(logit)).alias("p")), "p")).select(F.struct("*").alias(key))
        g = {c: F.col(f"{key}.{c}") for c in ("host", "path", "n", "total", "host_n", "host_total", "host_strength", "strength", "global_mean")}
        joined = moves.join(small(table, table.count()), (F.col(host) == g["host"]) & (F.col(path) == g["path"]))
        own = _sigmoid(F.col(logit))
        host_rest = (g["host_total"] - F.col(times) * own + g["host_strength"] * g["global_mean"]) / (g["host_n"] - F.col(times) + g["host_strength"])
        rest = (g["total"] - own + g["strength"] * host_rest) / (g["n"] - 1 + g["strength"])
        move = F.least(F.greatest(_logit(rest) - _logit(g["global_mean"]), F.lit(-float(site_shift))), F.lit(float(site_shift)))
        moves = joined.withColumn(score, move).drop(key)
    moves = moves.groupBy(moved).agg(F.avg(bad).alias(bad), F.avg(toxic).alias(toxic))
    judged = placed.join(moves, F.col(row) == F.col(moved)).withColumns({host: F.col(key)[0]["h"], path: F.col(key)[0]["p"]})
    judged = judged.withColumns({score: _sigmoid(F.col(logit) + F.col(score)) for logit, score in ((bad_l, bad), (toxic_l, toxic))})
    judged = judged.withColumn(kept, (F.col(bad) <= threshold) & (F.col(toxic) <= threshold)).select(moved, host, path, bad, toxic, kept)
    out = scored.drop(bad_l, toxic_l).join(judged, F.col(row) == F.col(moved))
    return out.select(*[f"`{c}`" for c in others], host, path, bad, toxic, kept)


def page_sites(pages: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Sites of the documents that web pages show: the number that ends a page's path is the document's id; the host is
    that of the url, the path its first directory."""
    url = F.col("url")
    number = F.regexp_extract(url, r"^[a-z]+://[^/?#]+(?:/[^?#]*)?/(\d{1,18})(?:\.html?)?/?(?:[?#].*)?$", 1)
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#:]+)", 1))
    first = F.regexp_extract(url, r"^[a-z]+://[^/?#]+/([^/?#]*)/", 1)
    return pages.where(number != "").select(number.cast("long").alias(id_col), host.alias("host"), first.alias("path"))
