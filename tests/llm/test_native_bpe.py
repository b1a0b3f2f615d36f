"""The fold of ranked merges in higher-order functions alone: right, but dearer than op 4's budget (figures in the README)."""

import json

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from lexweave.llm import bpe

BUCKETS, NONE = 1 << 17, 1 << 30


def native_ids(word, coder):
    """Ids of a word: its bytes, folded by `aggregate` over a literal of small maps from pairs of ids to ranks."""
    buckets = [{} for _ in range(BUCKETS)]
    for pair, rank in zip(coder.keys.tolist(), coder.values.tolist(), strict=True):
        buckets[pair % BUCKETS][str(pair)] = rank
    ranks = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>").cast("array<map<bigint,int>>")

    def rank(a, b):
        pair = a.cast("bigint") * coder.width + b
        return F.coalesce(F.try_element_at(F.get(ranks, F.pmod(pair, F.lit(BUCKETS)).cast("int")), pair), F.lit(NONE))

    def let(value, use):
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def merged(ids, found):
        at = lambda least: F.array_position(found, least).cast("int")
        joined = lambda least, i: F.concat(F.slice(ids, F.lit(1), i - 1), F.array(least), F.slice(ids, i + 2, F.size(ids)))
        return let(F.array_min(found), lambda least: F.when(least == NONE, ids).otherwise(let(at(least), lambda i: joined(least, i))))

    def step(ids, _):
        found = F.struct(F.transform(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: rank(F.get(ids, i), F.get(ids, i + 1))).alias("r"))
        return F.when(F.size(ids) < 2, ids).otherwise(let(found, lambda s: merged(ids, s["r"])))

    size, digits = F.octet_length(word), F.hex(F.encode(word, "UTF-8"))
    first = F.transform(F.sequence(F.lit(1), size), lambda i: F.get(F.lit(coder.bytes_to_id.tolist()), F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int")))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), first.cast("array<int>"), step)


def test_native_fold_is_tiktoken(spark):
    coder = bpe.Bpe(bpe.vocabulary(), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    words = ["a", " the", " Entzündungsgefahr", "aaaaaaa", " антидизэстеблишмент", "的的的", "xqzjvk", "%%%&&&", "é", " ththoner"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", native_ids(F.col("w"), coder).alias("ids")).collect()
    assert {r.w: r.ids for r in got} == {w: enc.encode_ordinary(w) for w in words}
