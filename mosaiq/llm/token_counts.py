"""Token counts of texts under a public byte-level BPE vocabulary, without token ids of texts.

Texts are cut into pre-tokens. The distinct pre-tokens of the whole corpus make a table, in which the
pieces of each are counted once; the table is joined to the pre-token frequencies of each document,
and the products are summed. The commonest pre-tokens, a bounded number, are sent to the executors
and joined there; all others are joined by a shuffle on the pre-token itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.llm.common import batches, most_frequent
from mosaiq.scratch import Scratch

#: Characters on which all Unicode versions agree; texts with others are cut by the library itself.
PLAIN = r"[\t\n\r\x20-\x7e¡-ſΑ-ΡА-я‐-‟•…€]*"
#: Distinct pre-tokens that a task holds before it hands on their counts.
HELD = 400_000
#: Pre-tokens that are sent to the executors, and their greatest length.
COMMON, SHORT = 300_000, 32


def _pattern() -> str:
    """The pre-token pattern of byte-level vocabularies, with the letters, digits and blanks among the plain characters spelled out."""
    plain = re.compile(PLAIN).fullmatch
    chars = [c for c in map(chr, range(0x2100)) if plain(c)]
    of = lambda kind: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind)
    letters, digits, blanks = of("L"), of("N"), r"\t\n\r "
    # The parts of the pattern.
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{blanks}{letters}{digits}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+"


def _cutter(path: str) -> Callable[[str], tuple[list[str], int]]:
    """text -> its pre-tokens, and the special strings in it, which count as one token each."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    find, plain = re.compile(_pattern()).findall, re.compile(PLAIN).fullmatch
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    split = re.compile("|".join(map(re.escape, added))) if added else None

    def one(text: str) -> list[str]:
        return find(text) if plain(text) else [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]

    def cut(text: str) -> tuple[list[str], int]:
        parts = split.split(text) if split else [text]
        return (one(text), 0) if len(parts) == 1 else ([x for p in parts for x in one(p)], len(parts) - 1)

    return cut


def piece_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(token, n, pieces): each distinct pre-token of all texts, how often it occurs, and its pieces, counted once."""

    def distinct(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, held = _cutter(path), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            found = list(held.items())
            held.clear()
            for i in range(0, len(found), 50_000):
                tokens, n = zip(*found[i : i + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(n, pa.int64())], names=["token", "n"])

        for b in batches(it):
            for t in b.column(0).to_pylist():
                if t:
                    held.update(cut(t)[0])
                    if len(held) > HELD:
                        yield from out()
        yield from out()

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        for b in batches(it, 500_000):
            pieces = list(map(len, tok.encode_batch_fast(b.column(0).to_pylist(), add_special_tokens=False)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.int64())], names=[*b.schema.names, "pieces"])

    found = docs.select(docs[text]).mapInArrow(distinct, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return found.mapInArrow(count, "token string, n long, pieces long")


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """`keep` columns and n_bytes, n_tokens, over_limit of every row.

    path: a tokenizers .json file with a byte-level pre-tokenizer. Null and empty texts have 0
    bytes and 0 tokens; repeated rows give repeated results, rows being told apart by their place;
    an empty table gives no rows. Columns that are not kept are not read, whatever their names; a
    kept one of a result's name is refused by Spark as ambiguous only when it is used. Special
    strings inside a text count as one token, the library's default.
    """
    cuts = Scratch(docs.sparkSession, "tokens")
    pieces = cuts.cut(piece_table(docs, path, text), "pieces")
    top = most_frequent(pieces.where(F.length("token") <= SHORT), "n", COMMON).select("token", "pieces").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(top)
    cols = docs.select(F.struct(*[docs[c] for c in keep]).alias("keep"), docs[text].alias("text"))
    rare = T.ArrayType(T.StructType().add("token", "string").add("m", "long"))
    schema = T.StructType().add("row", "long").add(cols.schema["keep"]).add("n_bytes", "long").add("n_tokens", "long").add("rare", rare)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = _cutter(path), dict(zip(*(c.to_pylist() for c in shared.value.columns), strict=True))
        row = TaskContext.get().partitionId() << 40
        kind = pa.list_(pa.struct([("token", pa.string()), ("m", pa.int64())]))
        for b in batches(it):
            n_bytes, n_tokens, others = [], [], []
            for t in b.column(1).to_pylist():
                tokens, total = cut(t) if t else ([], 0)
                left = []
                for p, m in Counter(tokens).items():
                    k = known.get(p)
                    if k is None:
                        left.append({"token": p, "m": m})
                    else:
                        total += m * k
                n_bytes.append(len(t.encode()) if t else 0)
                n_tokens.append(total)
                others.append(left)
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + b.num_rows), pa.int64()), b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(others, kind)], names=["row", "keep", "n_bytes", "n_tokens", "rare"])
            row += b.num_rows

    done = cuts.cut(cols.mapInArrow(sums, schema), "sums")
    more = done.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.m").join(pieces.select("token", "pieces"), "token")
    more = more.groupBy("row").agg(F.sum(F.col("m") * F.col("pieces")).alias("more"))
    out = done.drop("rare").join(more, "row", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return out.select("keep.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
