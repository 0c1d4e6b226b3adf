"""Byte-fallback BPE of SentencePiece models by a table of each prefix's last token, and decoding."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, doc_columns, steps, table

#: Runs of up to so many characters, and pairs of tokens, are looked up again where they come again; a full table is emptied.
RUN_CHARS, RUNS, PAIRS = 64, 1 << 18, 1 << 18

#: Kinds of pieces in a model (fixed values of the file format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


class PrefixTable:
    """Encoder of a BPE model with byte fallback.

    Which symbols merge follows from their joined text alone, so a sequence of tokens is what merging gives just if each
    token comes out of merging its own text and each neighbouring pair comes out of merging theirs. Hence every prefix of
    a text has one last token: of the tokens that end there (an automaton finds them) the one that goes with the last
    token of the prefix before it. Ids are read from the end of that table backwards.
    """

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = SentencePieceProcessor(model_file=model_file)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        if model.trainer_spec.model_type != BPE or not model.trainer_spec.byte_fallback:
            raise ValueError(f"not a BPE model with byte fallback: {model_file}")
        if any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError(f"a model with user-defined or unused pieces: {model_file}")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.id_of = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}
        within = sorted({p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)})
        chars = sorted(set("".join(within)))
        # Classes of characters that stand in longer pieces; 0 is any other.
        self.class_of = np.zeros(0x110000, dtype=np.uint16 if len(chars) < 65535 else np.uint32)
        for k, c in enumerate(chars):
            self.class_of[ord(c)] = k + 1
        self.wide = len(chars) + 1
        inside = {(int(self.class_of[ord(x)]) * self.wide + int(self.class_of[ord(y)])) for x, y in within}
        self.together = np.zeros(self.wide * self.wide, dtype=bool)
        self.together[sorted(inside)] = True
        self.automaton = ahocorasick.Automaton()
        for token in chain(chars, (p for p in self.id_of if len(p) > 1 and self.merged(p) == [p])):
            self.automaton.add_word(token, token)
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """What merging gives for a short text: the best joined piece first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            ranked = [(self.rank[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.rank]
            if not ranked:
                break
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def agree(self, a: str, b: str) -> bool:
        """Whether merging the text of both tokens gives both."""
        found = self.agreed.get((a, b))
        if found is None:
            if len(self.agreed) >= PAIRS:
                self.agreed.clear()
            found = self.agreed[a, b] = self.merged(a + b) == [a, b]
        return found

    def ids_of(self, token: str) -> Iterable[int]:
        """The token's id, or those of its bytes if it is a character that the model lacks."""
        found = self.id_of.get(token)
        return (found,) if found is not None else (self.bytes[b] for b in token.encode())

    def run_ids(self, run: str) -> list[int]:
        """Ids of a run of characters (of one character, or all of which stand in longer pieces)."""
        if len(run) == 1:
            return list(self.ids_of(run))
        last: list[str] = [""] * (len(run) + 1)
        for at, token in self.automaton.iter(run):
            end, start = at + 1, at + 1 - len(token)
            if not last[end] and (start == 0 or (last[start] and self.agree(last[start], token))):
                last[end] = token
        tokens, end = [], len(run)
        while end:
            tokens.append(last[end])
            end -= len(last[end])
        return list(chain.from_iterable(map(self.ids_of, reversed(tokens))))

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin and end.

        Merging never crosses two neighbouring characters that no piece has next to each other; the runs between such
        places are encoded alone.
        """
        text = self.library.normalize(text)
        if not text:
            return []
        codes = self.class_of[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)
        cuts = (np.flatnonzero(~self.together[codes[:-1] * self.wide + codes[1:]]) + 1).tolist()
        out: list[int] = []
        for start, end in zip([0, *cuts], [*cuts, len(text)], strict=True):
            run = text[start:end]
            ids = self.known.get(run)
            if ids is None:
                ids = self.run_ids(run)
                if end - start <= RUN_CHARS:
                    if len(self.known) >= RUNS:
                        self.known.clear()
                    self.known[run] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@cache
def prefix_table(model_file: str) -> PrefixTable:
    """One a worker process."""
    return PrefixTable(model_file)


def encode_pieces(docs: DataFrame, model_file: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids and, if asked for, the text decoded from them (decoded): a row for each row of docs, in no exchange.

    model_file: a SentencePiece BPE model with byte fallback, at that path on every machine. Whole texts are encoded,
    whatever their length; null and empty ones have no ids and decode to an empty text. Decoding restores neither a mark
    of a space (U+2581) that a text had nor what the model's normalisation changed. Repeated rows come out alike, rows
    without an id keep none, other columns are not kept, whatever their names.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_file)
        for b in batches:
            for at, texts in steps(b):
                ids = [table.encode(t.decode()) for t in texts]
                out = {"doc_id": (b.column(0).slice(at, len(texts)), pa.int64()), "ids": (ids, pa.list_(pa.int32()))}
                if decoded:
                    out["decoded"] = ([table.decode(i) for i in ids], pa.string())
                yield batch(out)

    return doc_columns(docs).mapInArrow(rows, "doc_id long, ids array<int>" + (", decoded string" if decoded else ""))


def decode_pieces(rows: DataFrame, model_file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """doc_id and the text of its ids; null ids are none, so their text is empty. An id that the model lacks is an error."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model_file)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield batch({"doc_id": (part.column(0), pa.int64()), text: ([table.decode(i or []) for i in part.column(1).to_pylist()], pa.string())})

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(texts, f"doc_id long, `{text}` string")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests."""
    import public_tokenizers

    found = encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
