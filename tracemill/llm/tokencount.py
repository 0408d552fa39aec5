"""Token counts of a byte-level word BPE without token ids.

The pre-tokens of the corpus are counted, each distinct one is encoded once, and a document's count is the sum over its
pre-tokens of frequency times pieces. Pre-tokens that make up at least ``hot_share`` of all (at most 1 / ``hot_share`` of
them, whatever the corpus) are joined by broadcast within the pass that counts a document's frequencies; only the others
are shuffled. So no frequent pre-token ever gathers in one task.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._shared import counted, parked, texts_of

#: Fixed values of the tokenizer's file: contractions, runs of letters, single numerals, runs of anything else but white space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: The settings of the tokenizer's file that WordPreTokenizer carries out.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
PLAIN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def check(spec: dict) -> None:
    """Raises ValueError for a tokenizer whose settings are others than those carried out here, lest it be counted wrongly."""
    if spec.get("normalizer") != NORMALIZER:
        raise ValueError(f"unknown normalizer: {spec.get('normalizer')}")
    if spec.get("pre_tokenizer") != {"type": "Sequence", "pretokenizers": [SPLIT, BYTES]}:
        raise ValueError(f"unknown pre-tokenizer: {spec.get('pre_tokenizer')}")
    for t in spec["added_tokens"]:
        if any(t.get(k) != v for k, v in PLAIN.items()):
            raise ValueError(f"unknown kind of added token: {t}")
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        raise ValueError("the model has to be BPE without dropout")


class WordPreTokenizer:
    """Splits texts as the tokenizer file does before its merges: special strings, NFC, lower case, pre-tokens. Files with other
    settings are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.path = path
        self._ready()

    def _ready(self) -> None:
        self._special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self._find = regex.compile(PRE_TOKEN).findall

    def __getstate__(self):
        return {"specials": self.specials, "path": self.path}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def __call__(self, text: str) -> list[str]:
        """Pre-tokens; each special string gives one that starts with a line feed, which no other can hold."""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out: list[str] = []
        at = 0
        for m in self._special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append("\n" + m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form: each character is lowered by itself
        return self._find(text.lower())


def pieces_of(path: str):
    """A function from pre-tokens to their numbers of pieces."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.normalizer = normalizers.Sequence([])
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def run(tokens: list[str]) -> list[int]:
        plain = tok.encode_batch_fast([t if t[0] != "\n" else "" for t in tokens], add_special_tokens=False)
        return [1 if t[0] == "\n" else len(e) for t, e in zip(tokens, plain)]

    return run


def piece_table(docs: DataFrame, pre: WordPreTokenizer) -> DataFrame:
    """(token, n, pieces) for each distinct pre-token of the texts, each encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(pre.path)
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(pieces(tokens) if tokens else [], pa.int64())], ["token", "n", "pieces"])

    return parked(counted(docs, pre, "pretokens").mapInArrow(encode, "token string, n long, pieces long"), "pieces")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, hot_share: float = 2e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    A null text counts as empty: no bytes, no tokens. Rows with the same id stay apart, null ids included. Other columns of
    ``docs`` are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pre = WordPreTokenizer(tokenizer)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = piece_table(rows, pre)
    total = pieces.agg(F.sum("n")).first()[0] or 0
    hot = {r.token: r.pieces for r in pieces.filter(F.col("n") >= max(1.0, hot_share * total)).select("token", "pieces").collect()}
    shipped = spark.sparkContext.broadcast(hot)
    id_type = rows.schema["id"].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            row, token, freq = [], [], []
            rids, n_bytes, n_hot = batch.column("rid").to_pylist(), [], []
            for rid, text in zip(rids, texts_of(batch)):
                tokens, n = 0, Counter(pre(text))
                for t, f in n.items():
                    p = known.get(t)
                    if p is None:
                        row.append(rid)
                        token.append(t)
                        freq.append(f)
                    else:
                        tokens += p * f
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_hot.append(tokens)
            # one row for the document, with a key that no pre-token can have, and one for each rare pre-token
            some, rare = len(rids), len(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rids + row, pa.int64()),
                    pa.concat_arrays([batch.column("id"), pa.nulls(rare, batch.column("id").type)]),
                    pa.array(n_bytes + [None] * rare, pa.int64()),
                    pa.array(n_hot + [0] * rare, pa.int64()),
                    pa.array([f" {r}" for r in rids] + token, pa.string()),
                    pa.array([0] * some + freq, pa.int64()),
                ],
                ["rid", "id", "n_bytes", "n_hot", "token", "freq"],
            )

    parts = rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(split, f"rid long, id {id_type.simpleString()}, n_bytes long, n_hot long, token string, freq long")
    rare = pieces.filter(F.col("n") < max(1.0, hot_share * total)).select("token", "pieces")
    summed = (
        parts.join(rare, "token", "left")
        .groupBy("rid")
        .agg(F.max("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("n_hot") + F.col("freq") * F.coalesce("pieces", F.lit(0))).alias("n_tokens"))
    )
    return summed.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
