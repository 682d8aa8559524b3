"""Quality rules: base rules, and how far a document's character classes and common words are from its language's.

One pass over the texts gives each document's counts; the references are the mean histograms of each language over
all documents that pass the base rules; a document is rejected when the Jensen-Shannon distance of a histogram to its
language's reference is over a limit and the document is long enough to judge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm import words as W
from veldt.llm.common import fresh, materialize, small, text_slices

SYMBOLS = b"#*$%&|<>"
#: Character classes of the histogram, by first byte of a code point; fixed values.
CLASSES = {"lower vowel": b"aeiou", "lower consonant": b"bcdfghjklmnpqrstvwxyz", "upper": bytes(range(65, 91)), "digit": b"0123456789", "blank": b" \t\x0b\x0c\r", "line end": b"\n", "stop": b".,;:!?'\"()-", "symbol": SYMBOLS, "beyond ASCII": bytes(range(0xC0, 0x100))}
OTHER_CLASS = len(CLASSES)
#: The most common words of some languages; fixed values. Other languages are judged by character classes alone.
COMMON_WORDS = {
    "en": "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were there one all we can her has been if more when will would who so no",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux ou mais comme cette ses on être deux leur nous tout même été sa fait aussi",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde",
}
#: Least characters and words to judge a histogram by; limits of the distances (0 to 1). The words of a document are a
#: sample, whose distance to its own source falls with the root of their number: WORD_SLACK / sqrt(words) is allowed too.
LEAST_CHARS, LEAST_WORDS = 200, 80
CLASS_LIMIT, WORD_LIMIT, WORD_SLACK = 0.25, 0.18, 1.0

_CLASS_OF = np.full(256, OTHER_CLASS, np.int64)
for _k, _some in enumerate(CLASSES.values()):
    _CLASS_OF[list(_some)] = _k
_CLASS_OF[0x80:0xC0] = OTHER_CLASS + 1  # the rest of a code point: not counted
_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums between offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document, its words in 3-word windows that it has twice or more."""
    n = len(hashes)
    if n < 3:
        return np.zeros(len(first) - 1, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    windows = W.mix(W.shingle_hashes(hashes, 3) + doc[: n - 2].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    inside = doc[: n - 2] == doc[2:]
    places = np.flatnonzero(inside)
    order = places[np.argsort(windows[places], kind="stable")]
    h, d = windows[order], doc[order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    marked = np.zeros(n, np.int64)
    for k in range(3):
        marked[order[twice] + k] = 1
    return _sums(marked, first)


def word_statistics(docs: DataFrame, *, text_col: str = "text", lang_col: str | None = "lang", languages: dict[str, str] | None = None) -> DataFrame:
    """docs without text_col, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the counts
    char_counts (by class) and word_counts (by common word of the row's language; the last is all other words)."""
    languages = COMMON_WORDS if languages is None else languages
    common = {lang: list(dict.fromkeys(some.split())) for lang, some in languages.items()}
    others = [c for c in docs.columns if c != text_col]
    names = fresh(docs.drop(text_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_counts", "word_counts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for lang, some in common.items():
            parts = [w.encode() for w in some]
            data = np.frombuffer(b" ".join(parts), np.uint8)
            starts, ends, _ = W.word_bounds(data, np.array([0, len(data)]))
            hashes = W.word_hashes(data, starts, ends)
            order = np.argsort(hashes)
            tables[lang] = (hashes[order], order)
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, end, data, offsets in text_slices(batch, 0):
                starts, ends, first = W.word_bounds(data, offsets)
                raw = W.word_hashes(data, starts, ends, lower=False)
                lower = W.word_hashes(data, starts, ends)
                n = end - at
                continued = (data & 0xC0) == 0x80
                chars = np.concatenate([[0], np.cumsum(~continued, dtype=np.int64)])
                in_words = _sums(chars[ends] - chars[starts], first)
                doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
                classes = np.bincount(doc * (OTHER_CLASS + 2) + _CLASS_OF[data], minlength=n * (OTHER_CLASS + 2)).reshape(n, -1)[:, :-1]
                symbols = _sums(_IS_SYMBOL[data], offsets)
                repeats = _repeated_words(raw, first)
                dups, counts, whole = [], [], data.tobytes()
                for i in range(n):
                    lines = [x for x in whole[offsets[i] : offsets[i + 1]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
                    dups.append(len(lines) - len(set(lines)))
                    table = tables.get(langs[at + i])
                    if table is None:
                        counts.append(None)
                        continue
                    hashes, order = table
                    own = lower[first[i] : first[i + 1]]
                    found = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    hit = hashes[found] == own
                    row = np.zeros(len(hashes) + 1, np.int64)
                    row[:-1] = np.bincount(order[found[hit]], minlength=len(hashes))
                    row[-1] = len(own) - hit.sum()
                    counts.append(row)
                longs = [np.diff(first), in_words, symbols, np.array(dups), repeats]
                lists = [pa.array(list(x), pa.list_(pa.int64())) for x in (classes, counts)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k + 2).slice(at, n) for k in range(len(others))], *[pa.array(x.astype(np.int64)) for x in longs], *lists], names=[*others, *names])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others], *[f"`{n}` long" for n in names[:5]], *[f"`{n}` array<long>" for n in names[5:]]])
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    return docs.select(F.col(f"`{text_col}`").cast("string").alias("rule_text"), lang.alias("rule_lang"), *[f"`{c}`" for c in others]).mapInArrow(count, schema)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values one after the other, and the length of each list (null: 0)."""
    lengths = np.array(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    return np.array(column.flatten(), np.float64), lengths


def _by_row(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def _shares(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return values / np.repeat(np.maximum(_by_row(values, lengths), 1), lengths)


def jensen_shannon(p: pa.Array, q: pa.Array) -> np.ndarray:
    """The distance (0 to 1) of each two lists of counts, or of shares; not a number where one is null."""
    both = np.array(pc.and_(pc.is_valid(p), pc.is_valid(q)), bool)
    out = np.full(len(p), np.nan)
    (x, lengths), (y, other) = _lists(p.filter(pa.array(both))), _lists(q.filter(pa.array(both)))
    if not np.array_equal(lengths, other):
        raise ValueError("histograms of different sizes")
    x, y = _shares(x, lengths), y
    middle = (x + y) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(x > 0, x * np.log2(x / middle), 0) + np.where(y > 0, y * np.log2(y / middle), 0)
    rows = np.zeros(len(lengths))
    np.add.at(rows, np.repeat(np.arange(len(lengths)), lengths), bits)
    out[both] = np.sqrt(np.maximum(rows / 2, 0))
    return out


def _share_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (language, counts by class, counts by word): for each language of a batch the sums of shares by place, and
    how many rows they are of."""
    for batch in batches:
        names, rows = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
        out = []
        for kind in (1, 2):
            values, lengths = _lists(batch.column(kind))
            shares = _shares(values, lengths)
            row = np.repeat(np.arange(len(lengths)), lengths)
            at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            width = int(lengths.max(initial=0))
            cell = rows[row] * width + at
            sums, counts = np.bincount(cell, shares, len(names) * width), np.bincount(cell, minlength=len(names) * width)
            used = np.flatnonzero(counts)
            out += [(str(names[c // width]), kind, int(c % width), float(sums[c]), int(counts[c])) for c in used]
        columns = zip(*out, strict=True) if out else [[]] * 5
        types = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["lang", "kind", "at", "total", "n"])


def quality_rules(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", languages: dict[str, str] | None = None, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT, least_chars: int = LEAST_CHARS, least_words: int = LEAST_WORDS
) -> DataFrame:
    """docs without text_col, with the base counts, base_failed, class_distance, word_distance and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. A distance is null where it
    isn't judged: fewer than least_chars code points or least_words words, or a language without reference. Null
    texts have no words; a null language is a language without common words. The references cover all documents that
    pass the base rules, as sums of shares by language, added up before they are shuffled, one row a language.
    Repeated rows count each; an empty table gives an empty table; other columns pass through.
    """
    n_words, word_chars, symbols, dup_lines, repeats, chars, common = fresh(docs.drop(text_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_counts", "word_counts")
    failed, class_d, word_d, kept, lang, rc, rw = fresh(docs, "base_failed", "class_distance", "word_distance", "kept", "rule_lang", "rule_rc", "rule_rw")
    counted = materialize(word_statistics(docs, text_col=text_col, lang_col=lang_col, languages=languages))
    counted = counted.withColumns({failed: (F.col(n_words) < 50) | (100 * F.col(repeats) > 50 * F.col(n_words)), lang: F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))})
    sums = counted.where(~F.col(failed)).select(lang, chars, common).mapInArrow(_share_sums, "lang string, kind int, at int, total double, n long")
    means = sums.groupBy("lang", "kind", "at").agg((F.sum("total") / F.sum("n")).alias("share"))
    ordered = means.groupBy("lang", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "share"))), lambda x: x["share"]).alias("shares"))
    references = ordered.groupBy(F.col("lang").alias(lang)).agg(F.max(F.when(F.col("kind") == 1, F.col("shares"))).alias(rc), F.max(F.when(F.col("kind") == 2, F.col("shares"))).alias(rw))
    references = materialize(references)
    others = [c for c in docs.columns if c != text_col]
    base = [n_words, word_chars, symbols, dup_lines, repeats]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars_of, words_of, class_means, word_means, bad = (batch.column(k) for k in range(5))
            words = batch.column(5 + len(others))
            n, base_failed = np.array(words, np.int64), np.array(bad, bool)
            long = _by_row(*_lists(chars_of)) >= least_chars
            by_class = np.where(long, jensen_shannon(chars_of, class_means), np.nan)
            by_word = np.where(n >= least_words, jensen_shannon(words_of, word_means), np.nan)
            far = (by_class > class_limit) | (by_word > word_limit + WORD_SLACK / np.sqrt(np.maximum(n, 1)))
            judged = [pa.array(base_failed), *[pa.array(d, pa.float64(), mask=np.isnan(d)) for d in (by_class, by_word)], pa.array(~base_failed & ~far)]
            yield pa.RecordBatch.from_arrays([*batch.columns[5:], *judged], names=[*others, *base, failed, class_d, word_d, kept])

    joined = counted.join(small(references, references.count()), lang, "left")
    own = [F.col(f"`{c}`") for c in (*others, *base)]
    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others], *[f"`{c}` long" for c in base], f"`{failed}` boolean, `{class_d}` double, `{word_d}` double, `{kept}` boolean"])
    return joined.select(chars, common, rc, rw, failed, *own).mapInArrow(judge, schema)
