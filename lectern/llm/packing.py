"""Cost-balanced packing of tokenised documents into fixed-length training sequences.

Method: the cost of a piece is LINEAR * length + QUADRATIC * length**2 (attention). Pieces are taken in
descending order and each goes to the sequence of lowest cost that still has room for it; where none has,
the sequence of lowest cost with any room is filled and the rest of the piece goes on. Documents longer
than a sequence first give off full sequences.

Packing needs no shuffle: a task packs what it has tokenised, in groups of GROUP_TOKENS tokens (memory is
bounded by the group and the longest single text). In a group of T tokens, T // 2048 sequences have
2048 tokens and one more each power of two in T % 2048, so that no sequence needs any padding.

Defined results: a null or empty text is the end-of-document id alone. The tokenizer's own added tokens, such as
``<|endoftext|>``, are one id where a text spells them out, as the tokenizer has it. Null or repeated ids are kept: every
row is a document. An empty table gives no rows. Other columns are never read. Sequence ids are
partition << 40 | number, unique over the table.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Kept, Recent, by_size, table

CAPACITY, END_ID = 2048, 1
GROUP_TOKENS = 4_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Entries of each generation of a worker's cache of words; there are two generations.
CACHE = 400_000
#: Bytes of texts that are encoded together (one text at least), and words that the tokenizer gets as one text.
TOGETHER, JOINED = 1 << 22, 500

#: Chunks of these characters are cut as the tokenizer's own pattern cuts them, and lower-cased alike.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+|\n")
#: White space of Python, of which the tokenizer itself decides.
_OTHER_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class Ids:
    """Ids of texts by a Hugging Face tokenizer that drops white space, with a cache of words.

    Tokens of such a tokenizer never span white space, so that a text's ids are those of its white-space-separated
    chunks in order. Equal chunks of the texts given together are cut and looked up once."""

    def __init__(self, source: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(source)
        own = self.tokenizer.get_added_tokens_decoder().values()
        #: Texts that spell out a token of the tokenizer's own go to it as they are.
        self.added, self.folded = [t.content for t in own], [t.content.lower() for t in own if t.normalized]
        size = self.tokenizer.get_vocab_size(True)
        self.type = np.uint16 if size < 1 << 16 else np.uint32
        #: No token's id: it stands at the end of each chunk.
        self.edge = np.iinfo(self.type).max
        self.words = Recent(CACHE)
        #: Tokens that end a word, if the tokenizer marks them.
        self.last, suffix = None, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.last = np.zeros(size, bool)
            self.last[[i for t, i in self.tokenizer.get_vocab(True).items() if t.endswith(suffix)]] = True

    def of_each(self, words: list[str]) -> list[bytes]:
        """The ids of each word, one by one."""
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def of_plain(self, words: list[str]) -> list[bytes]:
        """The ids of each word, of words that are one piece each: many as one text, cut after tokens that end a word."""
        if self.last is None:
            return self.of_each(words)
        out: list[bytes] = []
        for k in range(0, len(words), JOINED):
            some = words[k : k + JOINED]
            text = " ".join(some)
            if not any(a in text for a in (*self.added, *self.folded)):
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(some) and ends[-1] == len(ids):
                    flat, at = ids.tobytes(), (ends * ids.itemsize).tolist()
                    out += [flat[a:b] for a, b in zip([0, *at[:-1]], at, strict=True)]
                    continue
            out += self.of_each(some)
        return out

    def of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and where each chunk's begin and end."""
        plain = [_PLAIN.fullmatch(c) is not None for c in chunks]
        others = [c for c, p in zip(chunks, plain, strict=True) if not p]
        cut = _PIECES.findall("\n".join([*compress(chunks, plain), ""]).lower())
        pieces = [*cut, *chain.from_iterable((c, "\n") for c in others)]
        alone = set(others)
        new = self.words.missing(set(cut).union(alone) - {"\n"})
        for some, of in ((list(new - alone), self.of_plain), (list(new & alone), self.of_each)):
            self.words.update(zip(some, of(some), strict=True))
        self.words["\n"] = self.type(self.edge).tobytes()
        ids = np.frombuffer(b"".join(map(self.words.__getitem__, pieces)), self.type)
        order = np.argsort(~np.array(plain, bool), kind="stable")
        end = np.empty(len(chunks), np.int64)
        begin = np.empty(len(chunks), np.int64)
        end[order] = found = np.flatnonzero(ids == self.edge)
        begin[order] = np.concatenate([[0], found[:-1] + 1]) if len(found) else found
        return ids, begin, end

    def of_lists(self, lists: pa.ListArray) -> list[np.ndarray]:
        """The ids of each list of chunks."""
        coded = lists.flatten().dictionary_encode()
        ids, begin, end = self.of_chunks(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy()
        length = (end - begin)[which]
        after = np.concatenate([[0], np.cumsum(length)])
        flat = ids[np.repeat(begin[which] - after[:-1], length) + np.arange(after[-1])]
        at = after[lists.offsets.to_numpy()].tolist()
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        whole = np.zeros(len(column), bool)
        for some, of in ((self.added, column), (self.folded, pc.utf8_lower(column) if self.folded else column)):
            for a in some:
                whole |= pc.match_substring(of, a).to_numpy(zero_copy_only=False)
        other = pc.match_substring_regex(column, _OTHER_SPACE).to_numpy(zero_copy_only=False) & ~whole
        out = self.of_lists(pc.ascii_split_whitespace(pc.if_else(pa.array(whole | other), "", column)))
        if other.any():
            cut = [re.split(r"[ \t\n\r]+", t) for t in column.filter(pa.array(other)).to_pylist()]
            for k, ids in zip(np.flatnonzero(other).tolist(), self.of_lists(pa.array(cut, pa.list_(pa.string()))), strict=True):
                out[k] = ids
        for k in np.flatnonzero(whole).tolist():
            out[k] = np.array(self.tokenizer.encode(column[k].as_py(), add_special_tokens=False).ids, self.type)
        return out


def encoder(source: str) -> Ids:
    return Kept.get("packing", source, lambda: Ids(source))  # type: ignore[return-value]


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pack documents of these lengths: (document, start, length, sequence, offset) of each piece."""
    total, out, pieces = sum(lengths), [], []
    full, rest = divmod(total, capacity)
    room = [capacity] * full + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if rest >> k & 1]
    taken = 0
    for d, n in enumerate(lengths):
        for at in range(0, n - capacity + 1, capacity):
            out.append((d, at, capacity, taken, 0))
            taken += 1
        if n % capacity:
            pieces.append((n % capacity, d, n - n % capacity))
    size = np.array(room[taken:], np.int64)
    left, costs = size.copy(), np.zeros(len(size))
    for length, d, at in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while length:
            open_ = np.where(left >= length, costs, np.inf)
            s = int(open_.argmin())
            if left[s] < length:
                s = int(np.where(left > 0, costs, np.inf).argmin())
            n = min(length, int(left[s]))
            out.append((d, at, n, taken + s, int(size[s] - left[s])))
            left[s] -= n
            costs[s] += cost(n)
            at, length = at + n, length - n
    return out


FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
OUTPUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; ``tokenizer`` is the tokenizer file's content; ``with_ids`` adds the ids."""
    fields = FIELDS.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else FIELDS
    source = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, number = encoder(source.value), TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        held = 0
        end = np.array([end_id], ids_of.type)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            pieces = assign([len(t) for t in tokens], capacity)
            for k in range(0, len(pieces), 50_000):
                some = pieces[k : k + 50_000]
                cut = [tokens[d][at : at + n].astype("<u4") for d, at, n, _, _ in some]
                d, at, n, s, o = (np.array(x, np.int64) for x in zip(*some, strict=True))
                columns = {"doc_id": [doc_ids[i] for i in d], "start": at, "length": n, "ids_crc32": [zlib.crc32(c.tobytes()) for c in cut], "doc_tokens": [len(tokens[i]) for i in d], "sequence_id": (part << 40) + number + s, "offset": o, "ids": cut}
                yield table(columns, fields)
            number += max((p[3] for p in pieces), default=-1) + 1
            doc_ids.clear()
            tokens.clear()
            held = 0

        for batch in batches:
            for some in by_size(batch, 1, TOGETHER):
                for i, t in zip(some.column(0).to_pylist(), ids_of.encode(some.column(1)), strict=True):
                    doc_ids.append(i)
                    tokens.append(np.concatenate([t, end]))
                    held += len(t) + 1
                    if held >= GROUP_TOKENS:
                        yield from flush()
        if tokens:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, OUTPUT + (", ids array<int>" if with_ids else ""))


def tokenizer_source(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_source())
