"""Token counts over a digest cache.

Content digests and the tokenizer's version digest are joined to stored counts; only distinct contents that the cache
lacks are encoded, and their counts are appended to it.

Defined cases: a null text counts as empty (0 tokens); repeated rows each get a row; an empty table gives an empty
result; columns other than doc_id and text are ignored. A text has no size limit. Content is normalised before its digest
only as far as the tokenizer does so itself: white space at the ends goes where the tokenizer drops white space.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: White space as the tokenizers' pattern \s sees it (fixed values); no token spans it.
SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: Pieces between white space whose counts a Python worker remembers; when full it starts anew.
MEMO = 300_000
_tokenizers: dict = {}


def _load(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _tokenizers[path] = (None, lambda texts: [len(x) for x in model.encode(texts, num_threads=1)])
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _tokenizers[path] = ({} if _drops_space(path) else None, lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)])
    return _tokenizers[path]


def _drops_space(path: str) -> bool:
    """Whether the tokenizer removes white space before it looks for tokens, so that pieces can be counted alone."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return bool(parts) and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") is True and "\\s" in parts[0]["pattern"].get("Regex", "")


def version_of(path: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    lib = __import__("sentencepiece" if path.endswith(".model") else "tokenizers")
    digest = hashlib.sha256(lib.__version__.encode())
    with open(path, "rb") as f:
        digest.update(f.read())
    return digest.hexdigest()


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, encode_all = _load(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if memo is None:
                counts = encode_all(texts)
            else:
                counts = []
                for at in range(0, len(texts), 256):
                    pieces = [SPACE.split(t) for t in texts[at : at + 256]]
                    if len(memo) > MEMO:
                        memo.clear()
                    new = list({p for ps in pieces for p in ps if p not in memo})
                    memo.update(zip(new, encode_all(new), strict=True))
                    counts += [sum([memo[p] for p in ps]) for ps in pieces]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return encode


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; cache_path is a Parquet table in a shared store that grows
    with each call (without one, this call's own)."""
    spark = docs.sparkSession
    path = cache_path or common.fresh_path(spark, "token-cache")
    version = version_of(tokenizer_path)
    if cache_path is None or not _exists(spark, path):
        spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(path)
    text = F.coalesce("text", F.lit(""))
    content = F.btrim("text", F.lit(" \t\r\n")) if tokenizer_path.endswith(".json") and _drops_space(tokenizer_path) else F.col("text")
    keyed = docs.select("doc_id", text.alias("text")).withColumn("digest", F.unhex(F.sha2(content, 256)))

    def stored() -> DataFrame:
        mine = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version)
        return mine.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = keyed.select("digest", "text").dropDuplicates(["digest"]).join(stored().select("digest"), "digest", "left_anti")
    counted = misses.mapInArrow(_encoder(tokenizer_path), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(path)
    sized = common.settled(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "sized")
    hot = common.hot_keys(sized.groupBy("digest").agg(F.count("*").alias("n")), "digest", "n", sized.count())
    out = common.join_hot(sized, stored(), "digest", hot)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
