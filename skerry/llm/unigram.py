"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The model file (a parameter) is parsed for its pieces, scores and types; nothing is trained. White space is written as the
marker U+2581, with one marker before the text; characters without a piece fall back to byte pieces. No piece holds a
marker after another character (checked when a model is loaded), so the best path of a text is that of its words, each
with the spaces before it, one after another; each distinct word of an Arrow batch is searched once, all of them together, in NumPy.

Defined results: null and empty text encode to no pieces and decode to the empty text; equal path scores go to the path
whose last piece starts first; U+2581 in a text decodes to a space; bytes that are no UTF-8 decode to U+FFFD; extra columns
stay, an old ``piece_ids`` or ``decoded`` column is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.common import bounded_arrow, table
from skerry.llm.pieces import Memo, gather, list_array, split_batch

MARKER = "▁"
# Fixed values of the SentencePiece model format: piece types, and how far below the lowest score an unknown character is.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Words up to this many bytes are searched together in NumPy, longer ones one by one.
TOGETHER = 96


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at:at + n]
            at += n


@dataclass
class Model:
    """Pieces and their double-array trie: the child of state s by byte b is base[s] + b, if check[] there is s."""

    pieces: list[bytes]
    scores: np.ndarray
    types: np.ndarray
    dummy_prefix: bool
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    unknown_score: float
    longest: int
    byte_ids: np.ndarray
    unknown_id: int
    path: str


def build_trie(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of (key, value) pairs; state 0 is the root."""
    children: list[dict[int, int]] = [{}]
    values = [-1]
    for key, value in keys:
        node = 0
        for byte in key:
            nxt = children[node].get(byte)
            if nxt is None:
                nxt = len(children)
                children.append({})
                values.append(-1)
                children[node][byte] = nxt
            node = nxt
        values[node] = value
    size = 2 * len(children) + 1024
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    free = np.ones(size, bool)
    free[0] = False
    lowest = 1
    todo = [(0, 0)]
    while todo:
        node, state = todo.pop()
        value[state] = values[node]
        if not (kids := children[node]):
            continue
        labels = np.array(sorted(kids), np.int64)
        if not free[lowest]:
            lowest += int(np.argmax(free[lowest:]))
        at = lowest
        while True:
            spots = at + np.flatnonzero(free[at:at + 4096])
            spots = spots[spots > labels[0]] - labels[0]
            ok = np.ones(len(spots), bool)
            for label in labels[1:]:
                inside = spots + label < size
                ok &= inside & free[np.minimum(spots + label, size - 1)]
            if ok.any():
                place = int(spots[ok.argmax()])
                break
            at += 4096
            if at + 4096 > size:
                grow = size
                base, check, value = (np.concatenate([a, np.full(grow, f, np.int64)]) for a, f in ((base, 0), (check, -1), (value, -1)))
                free = np.concatenate([free, np.ones(grow, bool)])
                size += grow
        base[state] = place
        free[place + labels] = False
        check[place + labels] = state
        todo += [(kids[int(label)], place + int(label)) for label in labels]
    return base, check, value


_models: dict[str, Model] = {}


def load_model(path: str) -> Model:
    if path in _models:
        return _models[path]
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, types, dummy = [], [], [], True
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1])
            scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            types.append(piece.get(3, NORMAL))
        elif number == 3:
            dummy = bool(dict(_fields(value)).get(3, 1))
    kinds = np.array(types)
    usable = [(p, i) for i, p in enumerate(pieces) if types[i] in (NORMAL, USER_DEFINED) and p]
    mark = MARKER.encode()
    for p, i in usable:
        inner = p
        while inner.startswith(mark):
            inner = inner[len(mark):]
        if mark in inner:
            raise ValueError(f"piece {i} holds a space marker after another character: words are not independent")
    normal = [scores[i] for _, i in usable if types[i] == NORMAL]
    byte_ids = np.full(256, -1, np.int32)
    for i, p in enumerate(pieces):
        if types[i] == BYTE:
            byte_ids[int(p[3:5], 16)] = i
    value_scores = np.array(scores)
    top = max(normal)
    for p, i in usable:
        if types[i] == USER_DEFINED:
            value_scores[i] = len(p.decode()) * top - 0.1
    base, check, value = build_trie(usable)
    _models[path] = Model(pieces, value_scores, kinds, dummy, base, check, value, min(normal) - UNKNOWN_PENALTY,
                          max(len(p) for p, _ in usable), byte_ids, int(np.flatnonzero(kinds == UNKNOWN)[0]), path)
    return _models[path]


def _fallback(m: Model, char: bytes) -> list[int]:
    ids = m.byte_ids[np.frombuffer(char, np.uint8)]
    return ids.tolist() if (ids >= 0).all() else [m.unknown_id]


def _char_len(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def viterbi_one(m: Model, word: bytes) -> list[int]:
    """Best path of one (long) word."""
    n = len(word)
    best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    base, check, value, scores = m.base, m.check, m.value, m.scores
    at = 0
    while at < n:
        step = _char_len(word[at])
        state, single, score = 0, False, best[at]
        for end in range(at, min(n, at + m.longest)):
            nxt = int(base[state]) + word[end]
            if nxt >= len(check) or check[nxt] != state:
                break
            state = nxt
            piece = int(value[state])
            if piece >= 0:
                single |= end + 1 == at + step
                if score + scores[piece] > best[end + 1]:
                    best[end + 1], back[end + 1] = score + scores[piece], (at, piece)
        if not single and score + m.unknown_score > best[at + step]:
            best[at + step], back[at + step] = score + m.unknown_score, (at, -1)
        at += step
    out: list[list[int]] = []
    while n:
        at, piece = back[n]
        out.append([piece] if piece >= 0 else _fallback(m, word[at:n]))
        n = at
    return [i for run in reversed(out) for i in run]


def viterbi_many(m: Model, words: list[bytes]) -> list[list[int]]:
    """Best paths of many words at once: the same steps as viterbi_one, each done for all words that still take part."""
    n, lens = len(words), np.fromiter(map(len, words), np.int64, len(words))
    width = int(lens.max()) if n else 0
    grid = np.zeros((n, width), np.uint8)
    grid[np.arange(width) < lens[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    start, piece_at = np.zeros((n, width + 1), np.int16), np.full((n, width + 1), -1, np.int32)
    for at in range(width):
        rows = np.flatnonzero((lens > at) & ((grid[:, at] & 0xC0) != 0x80))
        if not len(rows):
            continue
        first = grid[rows, at].astype(np.int64)
        step = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
        single = np.zeros(n, bool)
        live, state, char = rows, np.zeros(len(rows), np.int64), step
        for end in range(at, min(width, at + m.longest)):
            nxt = m.base[state] + grid[live, end]
            ok = (nxt < len(m.check)) & (lens[live] > end)
            ok[ok] = m.check[nxt[ok]] == state[ok]
            live, state, char = live[ok], nxt[ok], char[ok]
            if not len(live):
                break
            piece = m.value[state]
            hit = piece >= 0
            r, p = live[hit], piece[hit]
            single[r[char[hit] == end + 1 - at]] = True
            score = best[r, at] + m.scores[p]
            up = score > best[r, end + 1]
            r = r[up]
            best[r, end + 1], start[r, end + 1], piece_at[r, end + 1] = score[up], at, p[up]
        lone = ~single[rows]
        r, to = rows[lone], at + step[lone]
        score = best[r, at] + m.unknown_score
        up = score > best[r, to]
        r, to = r[up], to[up]
        best[r, to], start[r, to], piece_at[r, to] = score[up], at, -1
    out = []
    starts, ids = start.tolist(), piece_at.tolist()
    for i, word in enumerate(words):
        end, run, s, p = len(word), [], starts[i], ids[i]
        while end:
            if p[end] >= 0:
                run.append(p[end])
            else:
                run += reversed(_fallback(m, word[s[end]:end]))
            end = s[end]
        out.append(run[::-1])
    return out


def encode_words(m: Model, words: list[str]) -> list[list[int]]:
    """Ids of words that each follow a space (whose marker is put before them); the words are searched in groups of like length."""
    data = [(MARKER + w).encode("utf-8", "replace") for w in words]
    out: list[list[int]] = [[]] * len(data)
    order = sorted(range(len(data)), key=lambda i: len(data[i]))
    for lo in range(0, len(order), 4096):
        group = order[lo:lo + 4096]
        small = [i for i in group if len(data[i]) <= TOGETHER]
        for i, ids in zip(small, viterbi_many(m, [data[i] for i in small])):
            out[i] = ids
        for i in group[len(small):]:
            out[i] = viterbi_one(m, data[i])
    return out


def encode_text(m: Model, text: str) -> list[int]:
    """Plain whole-text search, without splitting into words (for tests and single texts)."""
    if not text:
        return []
    return viterbi_one(m, ((MARKER if m.dummy_prefix else "") + text.replace(" ", MARKER)).encode("utf-8", "replace"))


#: Words known to a worker, for the model it used last. Every query brings its own copy of the model, so the key is the file.
_memos: dict[str, Memo] = {}
#: Texts that are encoded together: what a worker holds beside its Arrow batch grows with them.
AT_ONCE = 256


def _split(texts: pa.Array) -> pa.Array:
    """Words of each text; of a run of spaces all but the first are put before the word as markers."""
    runs = pc.replace_substring(pc.binary_join_element_wise("", texts, " "), "  ", " " + MARKER)
    return pc.split_pattern(pc.utf8_slice_codeunits(pc.replace_substring(runs, MARKER + " ", MARKER * 2), 1), " ")


def _ids_of(batch: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray]:
    if m.path not in _memos:
        _memos.clear()
        _memos[m.path] = Memo(lambda words: encode_words(m, words), limit=150_000)
    memo = _memos[m.path]
    offsets, codes, words = split_batch(batch, _split)
    slots = memo.slots(words.to_pylist())
    starts, lens = memo.starts[slots], memo.lens[slots]
    per_word = lens[codes]
    # an empty text has no words at all, not one empty word
    empty = np.asarray(pc.equal(pc.fill_null(batch, ""), ""))
    per_word[offsets[:-1][empty]] = 0
    bounds = np.concatenate([[0], np.cumsum(per_word)])
    return gather(memo.flat, starts[codes], per_word), np.diff(bounds[offsets])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), AT_ONCE):
            yield b.slice(at, AT_ONCE)


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """All columns of docs but the text, and ``piece_ids`` array<int>. The model is broadcast: its size is that of the
    vocabulary, whatever the corpus."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    model = load_model(model_path)
    if not model.dummy_prefix:
        raise ValueError("models without a dummy prefix are not supported")
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (text, "piece_ids")]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            ids, lens = _ids_of(b.column(text), shared.value)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], list_array(ids, lens)], names=[*keep, "piece_ids"])

    return docs.select(*[F.col(f"`{c}`") for c in [*keep, text]]).mapInArrow(run, schema)


def piece_bytes(m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each id decodes to: (all bytes, starts, lengths); control pieces decode to nothing."""
    runs = []
    for i, p in enumerate(m.pieces):
        kind = m.types[i]
        runs.append(bytes([int(p[3:5], 16)]) if kind == BYTE else " ⁇ ".encode() if kind == UNKNOWN
                    else b"" if kind == CONTROL else p.replace(MARKER.encode(), b" "))
    lens = np.fromiter(map(len, runs), np.int64, len(runs))
    return np.frombuffer(b"".join(runs), np.uint8), np.cumsum(lens) - lens, lens


_NEW = {"decoded": T.StringType(), "n_pieces": T.LongType(), "n_bytes": T.LongType(), "ids_crc32": T.LongType()}


def _decode_tables(m: Model) -> tuple[np.ndarray, ...]:
    return (*piece_bytes(m), m.types == BYTE)


def _decoded(ids: np.ndarray, offsets: np.ndarray, tables: tuple[np.ndarray, ...]) -> list[pa.Array]:
    """The columns of _NEW for texts whose ids lie between the offsets."""
    flat, starts, lens, is_byte = tables
    ends = np.concatenate([[0], np.cumsum(lens[ids])])
    data = gather(flat, starts[ids], lens[ids]).tobytes()
    fell = np.concatenate([[0], np.cumsum(is_byte[ids])])
    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    texts, crc = [], []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = data[ends[s]:ends[e]]
        texts.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
        crc.append(zlib.crc32(raw[4 * s:4 * e]))
    return [pa.array(texts, pa.string()), pa.array(np.diff(offsets)), pa.array(np.diff(fell[offsets])), pa.array(crc, pa.int64())]


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """All columns, with ``decoded`` text, ``n_pieces``, ``n_bytes`` (byte-fallback pieces) and ``ids_crc32`` added."""
    spark = encoded.sparkSession
    bounded_arrow(spark)
    shared = spark.sparkContext.broadcast(_decode_tables(load_model(model_path)))
    keep = [c for c in encoded.columns if c not in _NEW]
    schema = T.StructType([*[encoded.schema[c] for c in keep], *[T.StructField(k, v) for k, v in _NEW.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("piece_ids")
            made = _decoded(np.asarray(col.values), np.asarray(col.offsets).astype(np.int64), shared.value)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *made], names=[*keep, *_NEW])

    return encoded.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass over the batches: the ids cross to the JVM once and a task needs one Python worker."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    model = load_model(model_path)
    if not model.dummy_prefix:
        raise ValueError("models without a dummy prefix are not supported")
    shared = spark.sparkContext.broadcast((model, _decode_tables(model)))
    keep = [c for c in docs.columns if c not in (text, "piece_ids", *_NEW)]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("piece_ids", T.ArrayType(T.IntegerType())), *[T.StructField(k, v) for k, v in _NEW.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tables = shared.value
        for b in _slices(batches):
            ids, lens = _ids_of(b.column(text), m)
            made = _decoded(ids, np.concatenate([[0], np.cumsum(lens)]), tables)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], list_array(ids, lens), *made], names=[*keep, "piece_ids", *_NEW])

    return docs.select(*[F.col(f"`{c}`") for c in [*keep, text]]).mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text; per document the ids' number and checksum, and whether the text came back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    out = encode_and_decode(docs, path)
    return out.select("doc_id", "n_pieces", "n_bytes", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"),
                      (F.sha2("decoded", 256) == F.col("_sha")).alias("round_trip"))
