"""SentencePiece models on the tokenizers library.

The model file's protobuf is read field by field; its normaliser, space marker,
scores and byte fallback are rebuilt as a ``tokenizers`` pipeline. Texts are cut
before each run of space markers, which no piece crosses, so a batch is encoded
as its distinct chunks, multithreaded, and put together again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format
UNIGRAM, BPE = 1, 2  # model types of the format
_SUB_BATCH = 1 << 20  # characters put together at once
_SLICE = 200  # rows of an Arrow batch taken at once
_CACHE_CHUNKS = 200_000
THREADS = 2  # of the library in each task; set RAYON_NUM_THREADS for another number
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message, in wire order."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at:at + size]
            at += size
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at:at + size]
            at += size
        else:
            raise ValueError("not a SentencePiece model")


def read_model(data: bytes) -> dict:
    """Pieces (text, score, type) and the settings needed to rebuild a model."""
    pieces, trainer, norm = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0" * 4), "<f4")[0]), f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            norm = dict(_fields(value))
    if not pieces:
        raise ValueError("the model holds no pieces")
    return {"pieces": pieces, "type": trainer.get(3, UNIGRAM), "unk_id": trainer.get(40, 0),
            "byte_fallback": bool(trainer.get(35, 0)), "charsmap": norm.get(2, b""),
            "dummy_prefix": bool(norm.get(3, 1)), "squeeze": bool(norm.get(4, 1)), "escape": bool(norm.get(5, 1))}


def _merges(pieces: list) -> list[tuple[str, str]]:
    """Merge rules of a BPE model: all cuts of a piece into two pieces, pieces by
    falling score and, of one score, in order of their ids."""
    rank = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    rules = []
    for i, (p, score, kind) in enumerate(pieces):
        if kind == NORMAL:
            rules += [(-score, i, rank[p[:k]], rank[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
    return [(r[4], r[5]) for r in sorted(rules)]


def _cut(text: str) -> list[str]:
    """The text's chunks: a run of markers and what follows up to the next run."""
    if not text or MARK * 2 in text or not text.startswith(MARK) or text.endswith(MARK):
        return _CHUNK.findall(text)
    return [MARK + x for x in text[1:].split(MARK)]


class _Memory:
    """What ``make`` gives for keys seen lately; bounded, in two generations."""

    def __init__(self, make):
        self.make, self.young, self.old = make, {}, {}

    def of(self, keys: set) -> dict:
        if len(self.young) > _CACHE_CHUNKS:
            self.young, self.old = {}, self.young
        missing = keys - self.young.keys()
        seen = missing & self.old.keys()
        self.young.update((k, self.old[k]) for k in seen)
        new = list(missing - seen)
        self.young.update(zip(new, self.make(new)))
        return self.young


class Pieces:
    """Encoder and decoder of one SentencePiece model file's content."""

    def __init__(self, data: bytes):
        m = self.model = read_model(data)
        texts = [p for p, _, _ in m["pieces"]]
        self.crossing = [p for p in texts if re.search(f"[^{MARK}]{MARK}", p)]
        if m["type"] == BPE:
            core = models.BPE(vocab={p: i for i, p in enumerate(texts)}, merges=_merges(m["pieces"]), fuse_unk=True,
                              unk_token=texts[m["unk_id"]], byte_fallback=m["byte_fallback"])
        elif m["type"] == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in m["pieces"]], m["unk_id"], m["byte_fallback"])
        else:
            raise ValueError("only unigram and BPE models")
        self.backend = Tokenizer(core)
        steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
        if m["squeeze"]:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
        self.normalizer = normalizers.Sequence(steps) if steps else None
        # the space of the dummy prefix is taken off in decode()
        self.backend.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.chunk_ids = _Memory(self._encode_chunks)
        # the text of each piece; a NUL stands for those that only the library's decoder resolves:
        # control pieces and bytes of longer characters (a lone ASCII byte is always itself)
        self.shown = ["\0"] * len(texts)
        for i, (p, _, kind) in enumerate(m["pieces"]):
            if kind in (NORMAL, USER) and "\0" not in p:
                self.shown[i] = p.replace(MARK, " ")
            elif kind == BYTE and int(p[3:5], 16) < 0x80:
                self.shown[i] = chr(int(p[3:5], 16))

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<i4").tobytes() for e in self.backend.encode_batch_fast(chunks, add_special_tokens=False)]

    def normalise(self, text: str) -> str:
        """The text as the model sees it, spaces as markers."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        if not text:
            return ""
        if self.model["dummy_prefix"]:
            text = " " + text
        return text.replace(" ", MARK) if self.model["escape"] else text

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of whole texts; null and empty texts have none."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size < _SUB_BATCH):
                some.append(self.normalise(texts[at] or ""))
                size += len(some[-1])
                at += 1
            cut = [[t] if self.crossing and t else _cut(t) for t in some]
            known = self.chunk_ids.of(set().union(*cut))
            out += [np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<i4") for chunks in cut]
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts without byte pieces are their pieces in a row; the others go
        through the library's decoder."""
        whole = ["".join(map(self.shown.__getitem__, x.tolist())) for x in ids]
        odd = [i for i, text in enumerate(whole) if "\0" in text]
        for i, text in zip(odd, self.backend.decode_batch([ids[i].tolist() for i in odd], skip_special_tokens=False)):
            whole[i] = text
        return [t.removeprefix(" ") for t in whole] if self.model["dummy_prefix"] else whole


def parity(data: bytes, texts: list[str]) -> list[int]:
    """Positions of the texts that this backend encodes or decodes otherwise than
    the sentencepiece library."""
    import sentencepiece
    own, other = Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    ids = own.encode(texts)
    back = own.decode(ids)
    return [i for i, t in enumerate(texts) if ids[i].tolist() != other.encode(t) or back[i] != other.decode(ids[i].tolist())]


_BUILT: dict[int, Pieces] = {}


def _pieces(data: bytes) -> Pieces:
    """The encoder of the last model in this Python process."""
    key = xxhash.xxh64_intdigest(data)
    if key not in _BUILT:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        _BUILT.clear()
        _BUILT[key] = Pieces(data)
    return _BUILT[key]


def encode_column(text, model: bytes):
    """Token ids (array<int>) of a text column; null stays null."""
    @arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.int32()))]
        for at in range(0, len(texts), _SLICE):
            ids = _pieces(model).encode(texts.slice(at, _SLICE).to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32())))
        return pa.concat_arrays(out)
    return F.when(text.isNotNull(), encoded(text.cast("string")))


def decode_column(ids, model: bytes):
    """The text of a token id column; null stays null."""
    @arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        return pa.array(_pieces(model).decode([flat[a:b] for a, b in zip(ends[:-1], ends[1:])]), pa.string())
    return F.when(ids.isNotNull(), decoded(F.coalesce(ids, F.array().cast("array<int>"))))


def encode_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """documents -> (doc_id, n_tokens int, ids array<int>), one row per input
    row. Null and empty texts have no tokens. ``model`` is the content of a
    model file; it is sent to every task. Repeated rows are encoded each time, an
    empty table gives an empty table, other columns are not looked at."""
    none = F.array().cast("array<int>")
    return (docs.select("doc_id", F.coalesce(encode_column(F.col("text"), model), none).alias("ids"))
            .select("doc_id", F.size("ids").alias("n_tokens"), "ids"))


def encode_and_decode(docs: DataFrame, model: bytes) -> DataFrame:
    """documents -> doc_id, n_tokens, ids_digest (16 hex digits: XXH64, seed 42,
    of the ids as little-endian int32), decoded_bytes, same_text: whether
    decoding the ids gives the text again (null counts as empty)."""
    @arrow_udf("struct<n_tokens:int,ids_digest:string,decoded_bytes:bigint,same_text:boolean>")
    def both(texts: pa.Array) -> pa.Array:
        tool, names, rows = _pieces(model), ["n_tokens", "ids_digest", "decoded_bytes", "same_text"], []
        for at in range(0, len(texts), _SLICE):
            some = [t or "" for t in texts.slice(at, _SLICE).to_pylist()]
            ids = tool.encode(some)
            rows += [(len(x), xxhash.xxh64_hexdigest(x.astype("<i4").tobytes(), 42), len(back.encode()), back == text)
                     for x, back, text in zip(ids, tool.decode(ids), some)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        types = [pa.int32(), pa.string(), pa.int64(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return docs.select("doc_id", both(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*")
