"""SentencePiece encoding and decoding with distinct sampled segmentations.

A text is the lattice of its pieces; a path's weight is the product of its pieces' weights. Samples are drawn without
replacement by a perturbed A-star search: the whole lattice gets a Gumbel value; the region with the largest value is
taken off the queue, its path is drawn edge by edge, and what is left of the region is split where paths first leave
that path, each part with a Gumbel value below its parent's. Since each part's mass is known exactly, the values are
exact bounds, and paths come off in falling perturbed log-probability. The value of the next region gives every
sample's inclusion score. All randomness is a hash of the row key and the place in the text, so neither partitions nor
repeated tasks change a draw.

The search runs in the JVM (``java/Segmenter.java``): it is a few operations per character and sample, without a
vectorised form. Pieces never join over a gap between words, so the lattice is a chain of word lattices; those of
frequent words are kept, and memory grows with the pieces of one text only.
"""

from __future__ import annotations

import hashlib
import math
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadrille import compiled

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
TEMPERATURE = 0.5
SPACE = "▁"
SOURCE = Path(__file__).with_name("java") / "Segmenter.java"

Piece = tuple[str, int, float, bytes]  # kind (piece, byte or weight), id, log weight, UTF-8


def vocabulary(path: str) -> list[Piece]:
    """The pieces of a model with log weights, read on the driver. Where scores are merge ranks (0, -1, -2, ...), as in
    a BPE model, the weight of a piece falls with its rank as in Zipf's law; otherwise scores are log-probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    own = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
    scores = {i: sp.get_score(i) for i in own}
    ranks = all(s <= 0 and s == int(s) for s in scores.values())
    out: list[Piece] = [("piece", i, -math.log(10.0 - s) if ranks else s, sp.id_to_piece(i).encode()) for i, s in scores.items()]
    out += [("byte", sp.piece_to_id(f"<0x{b:02X}>"), 0.0, bytes([b])) for b in range(256)]
    return [*out, ("weight", 0, (-math.log(10.0 + n) if ranks else min(scores.values(), default=0.0)) - 1.0, b"")]


def decoder(pieces: list[Piece]):
    """A function from piece ids to text; the space that encoding puts before a text is taken off."""
    raw = {i: b if kind == "byte" else b.replace(SPACE.encode(), b" ") for kind, i, _, b in pieces if kind != "weight"}

    def decode(ids) -> str:
        return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "surrogatepass").removeprefix(" ")

    return decode


_registered: dict[str, str] = {}


def _register(spark: SparkSession) -> str:
    """Compile the search for this session and make it callable; executors fetch it from the driver."""
    session = f"{spark.sparkContext.applicationId}-{spark._jsparkSession.sessionUUID()}"
    if session in _registered:
        return _registered[session]
    compiled.add(spark, SOURCE)
    result = "array<struct<sample:int,n_pieces:bigint,log_prob:double,perturbed:double,inclusion:double,ids:array<int>,ids_sha256:string,round_trip:boolean>>"
    spark.udf.registerJavaFunction("__segmentations", "quadrille.llm.Segmenter", result)
    return _registered.setdefault(session, "__segmentations")


def _ship(spark: SparkSession, pieces: list[Piece]) -> str:
    """Send the vocabulary to all executors as a file; its size is bounded by the model's. Returns the file's name."""
    text = "".join(f"{kind}\t{i}\t{w!r}\t{b.hex()}\n" for kind, i, w, b in pieces)
    name = f"pieces-{hashlib.sha256(text.encode()).hexdigest()[:16]}.tsv"
    if not any(str(p).endswith(name) for p in spark.sparkContext.listFiles):
        path = Path(tempfile.mkdtemp(prefix="quadrille-")).resolve() / name
        path.write_text(text)
        spark.sparkContext.addFile(str(path))
    return name


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | list[Piece] = MODEL, samples: int = SAMPLES, temperature: float = TEMPERATURE, digest: bool = False) -> DataFrame:
    """Up to ``samples`` distinct segmentations of each row's whole text: doc_id, sample (from 0, by falling perturbed
    log-probability), n_pieces, log_prob, perturbed, inclusion, and ids (array of piece ids) or, with ``digest``,
    ids_sha256 (of the ids as little-endian 32-bit integers) and round_trip (whether decoding gives the text back).

    A row has fewer samples where its lattice has fewer paths. Null and empty texts have one sample without pieces,
    with log-probability 0 and inclusion 1. Rows with equal keys and texts, null keys among them, get equal samples.
    A text's own U+2581 is spelled in bytes, so it is not taken for a space. Other columns are not read; nothing is
    shuffled.
    """
    spark = docs.sparkSession
    name, file = _register(spark), _ship(spark, vocabulary(model) if isinstance(model, str) else model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = F.call_function(name, "text", "key", F.lit(file), F.lit(samples), F.lit(float(temperature)), F.lit(digest))
    out = rows.select("doc_id", F.inline(found))
    return out.drop("ids") if digest else out.drop("ids_sha256", "round_trip")


def decode(encoded: DataFrame, model: str | list[Piece] = MODEL, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with column text, decoded from its piece ids (null ids: null; no ids: the empty text)."""
    text = decoder(vocabulary(model) if isinstance(model, str) else model)

    @F.pandas_udf("string")
    def read(ids):
        return ids.map(lambda x: None if x is None else text(list(x)))

    return encoded.withColumn("text", read(F.col(ids_col)))
