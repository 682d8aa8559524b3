"""Token counts and token ids of whole texts.

Two ways to encode less than the whole text at a time, both exact:

* short texts are cut at blanks and line feeds where no pre-token of the vocabulary crosses those, and each distinct
  word is encoded once for a worker (a memo of bounded bytes);
* huge texts are encoded as overlapping chunks with offsets. Neighbouring chunks are spliced at a boundary that is
  proven stable: both encodings break there, the text has a separator there, and both encodings give the same
  tokens from there to the last separator that both have seen. If no such boundary is found, the overlap is
  widened, in the end to the whole text.

Both hold for vocabularies whose words are independent (see independent_words); with any other, each text is encoded
whole by the library.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import SLICE_BYTES, fresh

SEPARATORS = " \n"
#: Texts over so many characters are encoded as chunks of this size.
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Bytes that a worker remembers of words and their ids, with what each entry costs besides; then it starts anew.
MEMO_BYTES, ENTRY_BYTES = 224 << 20, 160
#: Longer words are encoded each time and not remembered.
MEMO_WORD_BYTES = 64
#: The expression that makes letters one pre-token, and a run of signs another one; and the signs that may end a word.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DEFAULT_VOCABULARY = "word_bpe_49k.json"

_loaded: dict[str, object] = {}


class Pieces:
    """A sentencepiece model with the one call that is used of a tokenizer."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str, add_special_tokens: bool = False) -> SimpleNamespace:
        return SimpleNamespace(ids=self.model.encode(text, add_bos=add_special_tokens, add_eos=add_special_tokens))


def load_tokenizer(vocabulary: str):
    """The tokenizer of a vocabulary file: a path, or a name that public_tokenizers knows. One for a process."""
    if vocabulary not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = vocabulary
        if not os.path.exists(path):
            import public_tokenizers

            path = str(public_tokenizers.path(vocabulary))
        if path.endswith(".model"):
            _loaded[vocabulary] = Pieces(path)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[vocabulary] = tokenizer
    return _loaded[vocabulary]


def independent_words(tokenizer) -> bool:
    """Whether words between blanks and line feeds are encoded each for itself.

    True only for what is known to be so: a normalizer of NFC, lower case and white space alone, a pre-tokenizer that
    keeps the matches of one expression, none of which has a blank or line feed in it, and special strings without them.
    """
    if isinstance(tokenizer, Pieces):
        return False
    import regex

    config = json.loads(tokenizer.to_str())
    parts = lambda x, key: [] if x is None else x[key] if x["type"] == "Sequence" else [x]
    for x in parts(config["normalizer"], "normalizers"):
        blanks = x["type"] == "Replace" and x["pattern"].get("Regex") in (r"\s+", r"\s") and x["content"] == " "
        if x["type"] not in ("NFC", "Lowercase") and not blanks:
            return False
    first, *rest = parts(config["pre_tokenizer"], "pretokenizers") or [{"type": "none"}]
    if first["type"] == "Split":
        if first["behavior"] != "Removed" or not first["invert"] or "Regex" not in first["pattern"]:
            return False
        pattern = regex.compile(first["pattern"]["Regex"])
        some = [chr(c) for c in range(33, 127)] + ["é", "日", "\u0301", "ab", "12", "!?"]
        probe = "".join(f"{x}{gap}{y}" for gap in (" ", "\n", "  ", " \n") for x in some for y in some)
        if any(" " in m[0] or "\n" in m[0] for m in pattern.finditer(probe)):
            return False
    elif first["type"] != "WhitespaceSplit":
        return False
    if any(x["type"] != "ByteLevel" or x["add_prefix_space"] or x["use_regex"] for x in rest):
        return False
    return not any(c.isspace() for t in tokenizer.get_added_tokens_decoder().values() for c in t.content)


def word_ends(tokenizer) -> np.ndarray | None:
    """Of each id, whether it ends a pre-token, for vocabularies that keep letters and the signs behind them apart.

    None for any other, and where a special string could be letters alone, or letters with signs behind them."""
    config = json.loads(tokenizer.to_str())
    first = (config["pre_tokenizer"].get("pretokenizers") or [{}])[0]
    suffix = config["model"].get("end_of_word_suffix")
    if first.get("pattern", {}).get("Regex") != LETTERS_APART or config["model"]["type"] != "BPE" or not suffix:
        return None
    contents = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    if any(c[:1].encode() not in [SIGNS[i : i + 1] for i in range(len(SIGNS))] or not any(x.isalpha() for x in c) for c in contents):
        return None
    ends = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
    ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
    return ends


class WordMemo:
    """Ids of words as little-endian unsigned 32-bit bytes, each distinct word encoded once."""

    def __init__(self, vocabulary: str, limit: int = MEMO_BYTES):
        self.tokenizer, self.limit = load_tokenizer(vocabulary), limit
        self.independent = independent_words(self.tokenizer)
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if self.independent else []
        self.lowers = self.independent and self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("AZ") == "az"
        self.ends = word_ends(self.tokenizer) if self.independent else None
        self.forget()

    def forget(self) -> None:
        self.known, self.bytes = {b"": b""}, 0

    def words(self, text: bytes) -> list[bytes]:
        """Cut at blanks and line feeds. If the vocabulary lower-cases, doing A-Z here makes fewer distinct words, but
        only where that can't make a special token out of other text."""
        if self.lowers and not any(m[:2] in text for m in self.marks):
            text = text.lower()
        return text.replace(b"\n", b" ").split(b" ")

    def ids(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Encode what isn't known; words that are too long to remember are returned."""
        if self.bytes > self.limit:
            self.forget()
        new = [w for w in words if w not in self.known]
        short = [w for w in new if len(w) <= MEMO_WORD_BYTES]
        if self.ends is None:
            self.learn_any(short)
        else:
            self.learn_apart(short)
        return {w: self.ids(w) for w in new if len(w) > MEMO_WORD_BYTES}

    def remember(self, words: list[bytes], raw: bytes, cuts: list[int]) -> None:
        """raw holds the ids of the words, each up to its cut."""
        last = 0
        for w, cut in zip(words, cuts, strict=True):
            self.known[w] = raw[4 * last : 4 * cut]
            last = cut
        self.bytes += sum(map(len, words)) + len(raw) + ENTRY_BYTES * len(words)

    def learn_any(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ends = np.cumsum([len(w.decode()) + 1 for w in some])
            got = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            starts = np.fromiter((o[0] for o in got.offsets), np.int64, len(ids))
            self.remember(some, ids.tobytes(), np.searchsorted(starts, ends).tolist())

    def learn_apart(self, words: list[bytes]) -> None:
        """Letters are one pre-token, which ends where an id says so; signs behind letters are another. Letters beyond Latin-1
        may get marks when they are normalized, which join the signs behind them; they stay together."""
        letters, split, rest = set(), [], set()
        for w in words:
            stem = w.rstrip(SIGNS)
            text = stem.decode()
            if not text.isalpha() or (len(stem) < len(w) and text[-1] > "\xff"):
                rest.add(w)
                continue
            if len(stem) < len(w):
                split.append((w, stem, tail := w[len(stem) :]))
                if tail not in self.known:
                    rest.add(tail)
            if stem not in self.known:
                letters.add(stem)
        letters = list(letters)
        for at in range(0, len(letters), 512):
            some = letters[at : at + 512]
            (got,) = self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):  # none has fewer than one, so each has one
                self.remember(some, ids.tobytes(), cuts.tolist())
            else:  # letters to Python, but not to the expression after normalizing
                self.learn_any(some)
        self.learn_any(list(rest))
        for w, stem, tail in split:
            ids = self.known[w] = self.known[stem] + self.known[tail]
            self.bytes += len(w) + len(ids) + ENTRY_BYTES

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text."""
        if not self.independent:
            yield from map(self.ids, texts)
            return
        cut = [self.words(t) for t in texts]
        long = self.learn(set().union(*cut))
        known = self.known
        for words in cut:
            if long:
                yield b"".join([known[w] if w in known else long[w] for w in words])
            else:
                yield b"".join(map(known.__getitem__, words))


_memos: dict[str, WordMemo] = {}


def word_memo(vocabulary: str) -> WordMemo:
    if vocabulary not in _memos:
        _memos[vocabulary] = WordMemo(vocabulary)
    return _memos[vocabulary]


def _encoded(tokenizer, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = tokenizer.encode(text[start:end], add_special_tokens=False)
    bounds = np.array(got.offsets, np.int64).reshape(-1, 2) + start
    return np.array(got.ids, np.uint32), bounds[:, 0], bounds[:, 1]


def _splice(text: str, left, right, low: int, high: int) -> int | None:
    """A stable boundary between low and high, the stretch that both encodings have seen; None if there is none."""
    seps = [i for i in range(low + 1, high) if text[i] in SEPARATORS and not text[i - 1].isspace()]
    if len(seps) < 3:
        return None
    last = seps[-1]
    middle = (low + high) // 2
    for p in sorted(seps[:-1], key=lambda i: abs(i - middle)):
        tails = []
        for ids, starts, ends in (left, right):
            at = int(np.searchsorted(starts, p))
            if at and ends[at - 1] > p:
                break
            tails.append(ids[at : int(np.searchsorted(starts, last))])
        else:
            if np.array_equal(*tails):
                return p
    return None


def encode_overlapping(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """The ids of a text by overlapping chunks; equal to encoding it whole."""
    n, parts, start, done = len(text), [], 0, 0
    end = min(n, chunk)
    left = _encoded(tokenizer, text, start, end)
    while end < n:
        wide = overlap
        while True:
            low = max(done, end - wide)
            stop = min(n, low + max(chunk, 2 * wide))
            right = _encoded(tokenizer, text, low, stop)
            p = _splice(text, left, right, low, end)
            if p is not None:
                ids, starts, _ = left
                parts.append(ids[np.searchsorted(starts, done) : np.searchsorted(starts, p)])
                done, end, left = p, stop, right
                break
            if low <= done:  # nothing stable in all of it: the left chunk itself grows
                end = min(n, end + max(chunk, end - done))
                left = _encoded(tokenizer, text, done, end)
                break
            wide *= 2
    ids, starts, _ = left
    parts.append(ids[np.searchsorted(starts, done) :])
    return np.concatenate(parts)


def encode_runs(run: list[bytes], vocabulary: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> Iterator[tuple[bytes, int]]:
    """For each text its ids as little-endian unsigned 32-bit bytes, and in how many chunks they were found."""
    memo, tokenizer = word_memo(vocabulary), load_tokenizer(vocabulary)
    huge = [memo.independent and len(t) > chunk_chars and len(t.decode()) > chunk_chars for t in run]
    for text, h, ids in zip(run, huge, memo.encode([b"" if h else t for t, h in zip(run, huge, strict=True)]), strict=True):
        if h:
            yield encode_overlapping(tokenizer, text.decode(), chunk_chars, overlap_chars).astype("<u4").tobytes(), -(-len(text) // chunk_chars)
        else:
            yield ids, int(bool(text))


def text_runs(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts as bytes (null: empty), in runs of about limit bytes."""
    run, size = [], 0
    for value in column.cast(pa.large_binary()):
        run.append(value.as_py() or b"")
        size += len(run[-1])
        if size > limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_counts(
    docs: DataFrame, *, text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS
) -> DataFrame:
    """docs without text_col, with n_bytes, n_tokens, n_chunks and over_limit (n_tokens > limit).

    Counts are those of the library for the whole text, without added begin or end tokens; special strings inside
    texts count as the library's default has them. Any vocabulary file of tokenizers (.json) or sentencepiece (.model)
    is right: one that is cased keeps its case, and one whose tokens may cross blanks encodes each text whole. Null and
    empty texts have 0 tokens and 0 chunks. Repeated rows are counted each; other columns pass through; an empty table
    gives an empty table. No shuffle; a worker holds one Arrow batch, its memo, and the chunks of one text.
    """
    n_bytes, n_tokens, n_chunks, over = fresh(docs, "n_bytes", "n_tokens", "n_chunks", "over_limit")
    others = [c for c in docs.columns if c != text_col]
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias(text_col), *[f"`{c}`" for c in others])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, chunks = [], [], []
            for run in text_runs(batch.column(0)):
                for text, (ids, parts) in zip(run, encode_runs(run, vocabulary, chunk_chars, overlap_chars), strict=True):
                    sizes.append(len(text))
                    counts.append(len(ids) // 4)
                    chunks.append(parts)
            new = [pa.array(x, pa.int64()) for x in (sizes, counts, chunks)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], names=[*others, n_bytes, n_tokens, n_chunks])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others], f"`{n_bytes}` long", f"`{n_tokens}` long", f"`{n_chunks}` long"])
    return source.mapInArrow(count, schema).withColumn(over, F.col(n_tokens) > limit)
