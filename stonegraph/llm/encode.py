"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel.
Where two neighbouring chunks agree on a pre-token's beginning in their
overlap, all later ones agree as well (the pattern looks forward only), so the
text is parted there; the parts are encoded in parallel and their ids put
together in order. Chunks without a common boundary stay one part. A text that
is a single chunk is one part from the start and is never shuffled.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonegraph.session import checkpointed

TOKENIZERS = "/opt/tokenizers"  #: folder of the vocabulary files
#: Fixed value: the pre-tokens of byte-level BPE, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP = 2_048, 256  #: characters


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    """The vocabulary file (some 800 KB), read on the driver."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return f.read()


def encoding(data: bytes):
    """The tiktoken encoding of a vocabulary file, without special tokens: strings that look like such are plain text."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoder(shared, lengths_only: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shared.value)
        for b in batches:
            ids = [[] if not t else enc.encode_ordinary(t) for t in b.column(b.num_columns - 1).to_pylist()]
            last = pa.array([len(x) for x in ids], pa.int64()) if lengths_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], last], names=[*b.schema.names[:-1], "out"])

    return encode


def boundaries(chunk: str, at: int, whole: bool) -> list[int]:
    """Offsets in the text where pre-tokens of a chunk that begins at ``at`` begin; without those that the cut at its end may have made (``whole``: it ends with the text)."""
    starts = [m.start() + at for m in regex.finditer(PATTERN, chunk)]
    return starts if whole else starts[:-2]


def _edges(chunk: int, overlap: int):
    """Of each chunk (row, n, length, text) the boundaries in its first and its last overlap.

    Only boundaries between two ASCII characters are offered, on which all
    libraries' tables of letters agree, and none after white space: how a run of
    it is parted depends on what follows, which the part before the cut lacks.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, tails = [], []
            for n, length, part in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                at = n * chunk
                sure = [p for p in boundaries(part, at, at + len(part) >= length) if p > at and part[p - at - 1].isascii() and not part[p - at - 1].isspace() and part[p - at].isascii()]
                heads.append(sure[: bisect_left(sure, at + overlap)])
                tails.append(sure[bisect_left(sure, at + chunk) :])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=["row", "n", "head", "tail"])

    return edges


def encode_texts(texts: DataFrame, *, id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, lengths_only: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids): the token ids of each row's text; with ``lengths_only`` (id, tokens), their number.

    Null and empty texts give an empty list (0). Rows keep their number:
    repeated rows come out repeatedly, and neither repeated nor null ids mix
    texts up. Extra columns are ignored; an empty table gives none. Decoding the
    ids, by concatenating their tokens' bytes, gives the text's UTF-8 again.
    Texts over ``chunk + overlap`` characters are cut into chunks; they are
    numbered and checkpointed when the function is called.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be positive and no longer than a chunk")
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(name, folder))
    kind = "bigint" if lengths_only else "array<int>"
    src = texts.select(F.col(id).alias("doc"), F.col(text).cast("string").alias("text"))
    doc_type = src.schema["doc"].dataType.simpleString()
    long_enough = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    short = src.where(~long_enough).mapInArrow(_encoder(shared, lengths_only), f"doc {doc_type}, out {kind}")
    length = F.length("text")
    long = checkpointed(src.where(long_enough).select(F.monotonically_increasing_id().alias("row"), "doc", "text"))  # the numbers hold only once they are written
    last = F.greatest(F.ceil((length - overlap) / chunk), F.lit(1)).cast("int")
    chunks = long.select("row", length.alias("length"), F.posexplode(F.transform(F.sequence(F.lit(0), last - 1), lambda n: F.substring("text", n * chunk + 1, chunk + overlap))).alias("n", "part")).select("row", "n", "length", "part")
    edges = chunks.repartition("row", "n").mapInArrow(_edges(chunk, overlap), "row bigint, n int, head array<int>, tail array<int>")
    edges = checkpointed(edges)
    follows = edges.select("row", (F.col("n") - 1).alias("n"), "head")
    meets = edges.select("row", "n", "tail").join(follows, ["row", "n"]).select("row", F.array_min(F.array_intersect("tail", "head")).alias("cut")).where("cut is not null")
    cuts = meets.groupBy("row").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    ends = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(length))
    parts = long.join(cuts, "row", "left").select("row", "text", ends.alias("ends"))
    parts = parts.select("row", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda k: F.substring("text", F.element_at("ends", k) + 1, F.element_at("ends", k + 1) - F.element_at("ends", k)))).alias("part", "piece"))
    coded = parts.repartition("row", "part").mapInArrow(_encoder(shared, lengths_only), f"row bigint, part int, out {kind}")
    if lengths_only:
        whole = coded.groupBy("row").agg(F.sum("out").alias("out"))
    else:
        whole = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "out"))).alias("p")).select("row", F.flatten(F.col("p.out")).alias("out"))
    whole = whole.join(long.select("row", "doc"), "row").select("doc", "out")
    return short.unionByName(whole).select(F.col("doc").alias(id), F.col("out").alias("tokens" if lengths_only else "ids"))


def decode(ids: list[int], data: bytes) -> str:
    return encoding(data).decode(ids)
