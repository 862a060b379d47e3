"""Operator 5: tokeniser fertility and base text rules (Arrow batches, numpy)."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pointweave.llm.common import in_batches, named

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Distinct words whose tokens one worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Entropy is held against log2 of the token count, or this many bits at most: a text's vocabulary saturates.
ENTROPY_BITS = 8.0

#: Bands by language, else by script: characters per token (least, most), byte-fallback share (most),
#: token entropy as a share of min(log2 tokens, ENTROPY_BITS) (least), share of tokens without a letter or digit (most).
BANDS = {
    "en": (1.6, 6.0, 0.10, 0.735, 0.22),
    "de": (1.5, 6.0, 0.10, 0.735, 0.22),
    "fr": (1.4, 6.0, 0.10, 0.735, 0.22),
    "es": (1.4, 6.0, 0.10, 0.725, 0.22),
    "LATIN": (1.2, 8.0, 0.20, 0.65, 0.25),
    "CYRILLIC": (1.0, 8.0, 0.20, 0.65, 0.25),
    "GREEK": (0.8, 6.0, 0.30, 0.60, 0.30),
    "CJK": (0.25, 4.0, 0.95, 0.50, 0.50),
    "OTHER": (0.25, 8.0, 0.95, 0.50, 0.50),
}

MEASURES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("chars_per_token", T.DoubleType()),
        T.StructField("byte_fallback_share", T.DoubleType()),
        T.StructField("token_entropy", T.DoubleType()),
        T.StructField("bare_share", T.DoubleType()),
        T.StructField("band", T.StringType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


class WordTokens:
    """Token ids of words, each encoded on its own: pieces never cross a word boundary in this vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.is_bare = ~self.is_byte & np.array([not any(c.isalnum() for c in self.model.id_to_piece(i)) for i in range(self.size)])
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.offsets, self.tokens = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        known = self.index
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > REMEMBERED and known:
            self.clear()
            known, new = self.index, list(dict.fromkeys(words))
        if new:
            coded = self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            counts = np.fromiter(map(len, coded), np.int64, len(new))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
            self.tokens = np.concatenate([self.tokens, np.fromiter((t for c in coded for t in c), np.int32, int(counts.sum()))])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


@functools.cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(ids: np.ndarray) -> int:
    """Words inside windows that occur twice or more: exact, by doubling window names from 1 to 8 words."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    names, width = ids.astype(np.int64), 1
    while width < WINDOW:
        left, right = names[:-width], names[width:]
        names = np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)[1]
        width *= 2
    twice = np.bincount(names)[names] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeats(ids: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document the repeated words; a hash of the windows rules out the documents without any."""
    out = np.zeros(len(counts), np.int64)
    ends = np.cumsum(counts)
    starts = ends - counts
    if len(ids) < WINDOW:
        return out
    with np.errstate(over="ignore"):
        noise, rolled = mixed(ids), np.zeros(len(ids) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + noise[k : k + len(rolled)]
        at = doc[: len(rolled)]
        rolled = rolled ^ mixed(at)
    inside = np.arange(len(rolled)) + WINDOW <= ends[at]
    rolled, at = rolled[inside], at[inside]
    order = np.argsort(rolled, kind="stable")
    rolled, at = rolled[order], at[order]
    for d in np.unique(at[1:][rolled[1:] == rolled[:-1]]):
        out[d] = repeated_words(ids[starts[d] : ends[d]])
    return out


def script(text: bytes) -> str:
    """The script of most of the text's distinct letters, LATIN without any."""
    seen: dict[str, int] = {}
    for c in {*text.decode("utf-8", "replace")}:
        if c.isalpha():
            name = unicodedata.name(c, "OTHER").split(" ")[0].split("-")[0]
            name = "CJK" if name in ("HIRAGANA", "KATAKANA", "HANGUL") else name
            seen[name] = seen.get(name, 0) + 1
    best = max(seen, key=lambda k: (seen[k], k), default="LATIN")
    return best if best in BANDS else "OTHER"


def measure(texts: list[bytes | None], langs: list[str | None], vocabulary: str, bands: dict) -> dict[str, np.ndarray]:
    """MEASURES for a batch of whole texts; a null text has no words."""
    texts = [t or b"" for t in texts]
    tokens = word_tokens(vocabulary)
    split = [t.split() for t in texts]  # bytes.split() cuts at exactly space, \t, \n, \v, \f, \r
    words = np.fromiter(map(len, split), np.int64, len(split))
    ids = tokens.look_up([w for ws in split for w in ws])
    doc = np.repeat(np.arange(len(texts)), words)
    first, size = tokens.offsets[ids], tokens.offsets[ids + 1] - tokens.offsets[ids]
    upto = np.cumsum(size)
    stream = tokens.tokens[np.repeat(first - (upto - size), size) + np.arange(int(size.sum()))]
    n_tokens = np.bincount(doc, size, len(texts)).astype(np.int64)
    token_doc = np.repeat(doc, size)
    fallback = np.bincount(token_doc, tokens.is_byte[stream], len(texts))
    bare = np.bincount(token_doc, tokens.is_bare[stream], len(texts))
    key = np.sort(token_doc * tokens.size + stream)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(key))).astype(float)
    clogc = np.bincount(key[edge] // tokens.size, count * np.log2(count), len(texts)) if len(key) else np.zeros(len(texts))
    many = np.maximum(n_tokens, 1)
    entropy = np.maximum(np.log2(many) - clogc / many, 0.0)
    chars = np.fromiter((len(t.decode("utf-8", "replace")) - sum(t.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")) for t in texts), np.int64, len(texts))
    symbols = np.fromiter((len(t) - len(t.translate(None, SYMBOLS)) for t in texts), np.int64, len(texts))
    dup_lines = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        lines = t.split(b"\n")
        if len(lines) > len(set(lines)):
            worded = [x for x in lines if x.strip()]
            dup_lines[i] = len(worded) - len(set(worded))
    repeat = repeats(ids, doc, words)
    failed = (words < 20) | (100 * repeat > 30 * words)
    band = [lang if lang in bands else (script(t) if t else "OTHER") for lang, t in zip(langs, texts, strict=True)]
    low, high, most, least, most_bare = (np.array([bands[b][k] for b in band], float).reshape(-1) for k in range(5))
    per = chars / many
    share = fallback / many
    dense = entropy / np.maximum(np.minimum(np.log2(many), ENTROPY_BITS), 1e-9)
    good = (per >= low) & (per <= high) & (share <= most) & (dense >= least) & (bare / many <= most_bare)
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat, "base_failed": failed, "n_tokens": n_tokens, "chars_per_token": per, "byte_fallback_share": share, "token_entropy": entropy, "bare_share": bare / many, "band": band, "kept": ~failed & good}


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _strings(batch: pa.RecordBatch, name: str | None) -> list[str | None]:
    return [None] * batch.num_rows if name is None else batch.column(name).cast(pa.string()).to_pylist()


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary: str = VOCABULARY, bands: dict = BANDS) -> DataFrame:
    """One row per input row: id and MEASURES over the whole text.

    A null text counts as empty: no words, base_failed, not kept. A null or unlisted language takes the band of the
    text's script. Repeated rows give repeated results, an empty table an empty one; other columns are not read. A
    measure that the id has the name of gets ``_result`` behind it.
    """
    docs = docs.select(*dict.fromkeys([id_col, text_col, *([lang_col] if lang_col else [])]))
    columns = [T.StructField(n, f.dataType) for n, f in zip(named(id_col, MEASURES.names), MEASURES.fields, strict=True)]
    out = T.StructType([docs.schema[id_col], *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = measure(_texts(b.column(text_col)), _strings(b, lang_col), vocabulary, bands)
            yield pa.RecordBatch.from_arrays([b.column(id_col), *(pa.array(got[f.name]) for f in MEASURES.fields)], names=out.names)

    return in_batches(docs, run, out)


def keep_quality(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", vocabulary: str = VOCABULARY, bands: dict = BANDS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that quality_rules keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(measure(_texts(b.column(text_col)), _strings(b, lang_col), vocabulary, bands)["kept"]))

    return in_batches(docs, run, docs.schema)
