"""Cross-tokenizer alignment with exact-text deduplication.

Rows are shuffled by their full text; each distinct text is tokenised by both tokenizers and aligned once, however many rows
hold it. Byte offsets where tokens of both sides end cut a text into groups; the two tokens that end there are a link. Links
are counted over the corpus, weighted by the number of rows that hold the text, and the measures of each text go back to its
rows by a SHA-256 of the text.

Three things are bounded by proof. A link's tokens end together, so one's bytes are a suffix of the other's; the number of
different links is therefore at most the number of suffixes of all tokens of both vocabularies (times the few tokens with
equal bytes), whatever the corpus, and the table of counts may be broadcast. Texts held by over one row in ``HOT_SHARE`` are
fewer than ``HOT_SHARE``, so their measures are broadcast and their rows stay where they are. Tokens of one step come from
about ``CHUNK_BYTES`` of text, or from one longer text.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, table, utf8, written

#: Folder of the vocabulary files, the same on every machine; the byte-level side and the piece side.
FOLDER, BYTE_FILE, PIECE_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A text is hot if more than one row in so many holds it.
HOT_SHARE = 1000


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as itself and the others, in order, as the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


# Fixed value: how byte-level vocabularies split a text before merging.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_vocabulary(path: str):
    """(function from texts to their lists of token ids, bytes of each id) of a byte-level vocabulary; a space goes before a text.

    Where the ids of merged tokens follow the order of the merges and nothing else is done to a text, merging by smallest id is
    the same and several times faster (tests compare both over all characters); otherwise the file's own library encodes.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    to, model = _byte_of(), file["model"]
    vocabulary = {**model["vocab"], **{t["content"]: t["id"] for t in file["added_tokens"]}}
    entries = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        entries[i] = bytes(to[c] for c in entry) if entry in model["vocab"] else entry.encode()
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    split = file["pre_tokenizer"] or {}
    plain = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and file["normalizer"] is None
             and not model.get("ignore_merges") and all(a < b for a, b in zip(merged, merged[1:])) and all(c in model["vocab"] for c in to)
             and len(set(entries)) == len(entries) and len(model["vocab"]) == 256 + len(merged))
    if plain:
        import tiktoken
        ranks = {entries[i]: i for i in model["vocab"].values()}
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(" " + t) for t in texts], entries
    return library_encoder(path), entries


def library_encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task on each core
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are then ordinary text
    return lambda texts: [e.ids for e in tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def piece_vocabulary(path: str):
    """The same of a model of pieces, which itself puts a space before a text."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, model.id_to_piece(i)) for i in range(model.vocab_size()))]
    return lambda texts: model.encode(texts, num_threads=1), entries


class Aligner:
    """Both vocabularies, as arrays for lookups."""

    def __init__(self, a, b):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = a, b
        self.len_a, self.len_b = (np.array([len(e) for e in entries], np.int64) for entries in (self.bytes_a, self.bytes_b))
        # what follows a token's number: "," inside its side of a group, "|" after A's side, ";" after B's
        self.parts = np.array([f"{i}{end}" for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for i in range(n) for end in ends], object)

    def align(self, text: str, ids_a: list[int], ids_b: list[int]):
        """(groups as text, number of groups, links as a << 32 | b), or None if either side's bytes are not those of the text."""
        raw = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b)) != raw:
            return None
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)  # no token is empty, so no side repeats an end
        last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)
        out = np.empty(len(a) + len(b), np.int64)
        part_a, part_b = 2 * a, 2 * (b + len(self.bytes_a))
        part_a[last_a] += 1
        part_b[last_b] += 1
        out[np.arange(len(a)) + np.r_[0, last_b + 1][np.searchsorted(both, end_a)]] = part_a
        out[np.arange(len(b)) + (last_a + 1)[np.searchsorted(both, end_b)]] = part_b
        return "".join(self.parts[out].tolist())[:-1], len(both), a[last_a] << 32 | b[last_b]


def _aligned(a_path: str, b_path: str, digest: bool):
    def run(batches):
        aligner = None
        for batch in batches:
            if aligner is None:
                aligner = Aligner(byte_vocabulary(a_path), piece_vocabulary(b_path))
            _, offsets = utf8(batch.column("text"))
            for i, j in pieces(offsets):
                part = batch.slice(i, j - i)
                texts = part.column("text").to_pylist()
                counts, groups, links = [], [], []
                for text, ids_a, ids_b in zip(texts, aligner.encode_a(texts), aligner.encode_b(texts)):
                    done = aligner.align(text, ids_a, ids_b)
                    shown, n, pair = ("", 0, np.zeros(0, np.int64)) if done is None else done
                    counts.append((len(ids_a), len(ids_b), n) if n else (0, 0, 0))
                    groups.append(hashlib.sha256(shown.encode()).hexdigest() if digest and n else shown)
                    links.append(pair)
                n_a, n_b, n_groups = zip(*counts)
                ends = np.cumsum([0, *map(len, links)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("copies"), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(groups, pa.string()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(links)))],
                    names=["key", "copies", "n_a", "n_b", "n_groups", "groups", "links"])
    return run


def aligned_texts(spark: SparkSession, docs: DataFrame, text: str = "text", folder: str = FOLDER, byte_file: str = BYTE_FILE,
                  piece_file: str = PIECE_FILE, digest: bool = False) -> DataFrame:
    """One row for each distinct text that is neither null nor empty: key (its SHA-256), copies, n_a, n_b, n_groups, groups, links.

    groups lists the token ids as ``a1,a2|b1;a3|b2,b3`` (with ``digest`` the SHA-256 of that); links holds a << 32 | b.
    A text that either tokenizer does not give back byte by byte has zeros, '' and no links. Texts are never cut.
    """
    texts = docs.select(F.col(text).alias("text")).filter("text is not null and text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    keyed = texts.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), "copies", "text")
    out = keyed.mapInArrow(_aligned(f"{folder}/{byte_file}", f"{folder}/{piece_file}", digest),
                           "key binary, copies long, n_a long, n_b long, n_groups long, groups string, links array<long>")
    return written(spark, out, "aligned")


def pair_counts(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """How often each pair of ids is linked, over all rows: (link, a, b, count, best); best: no other A id has more with this B id."""
    links = texts.select(F.explode("links").alias("link"), "copies").groupBy("link").agg(F.sum("copies").alias("count"))
    ids = links.select("link", F.shiftright("link", 32).cast("int").alias("a"), F.col("link").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "count")
    return written(spark, ids.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("b"))), "pairs")


def align(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False, **files) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    n_links: links of the text; n_best: those whose count over the corpus is the highest of their B id, ties included;
    count_sum: the sum of their counts. Null and empty texts, and texts that a tokenizer does not give back, have zeros and ''.
    Rows with repeated or null ids are rows of their own, equal texts give equal measures, an empty table gives no rows, and
    other columns of ``docs``, whatever their names, are not looked at.
    """
    texts = aligned_texts(spark, docs, text, digest=digest, **files)
    pairs = pair_counts(spark, texts).select("link", "count", "best")
    each = texts.select("key", "copies", "n_a", "n_b", "n_groups", "groups", F.explode_outer("links").alias("link"))
    measures = each.join(F.broadcast(pairs), "link", "left").groupBy("key", "copies", "n_a", "n_b", "n_groups", "groups").agg(
        F.count("link").alias("n_links"), F.count_if("best").alias("n_best"), F.coalesce(F.sum("count"), F.lit(0)).alias("count_sum"))
    measures = written(spark, measures, "measures")
    rows = written(spark, docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(F.col(text) != "", F.unhex(F.sha2(F.col(text).cast("binary"), 256))).alias("key")), "rows")
    hot = F.col("copies") * HOT_SHARE > rows.count()
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    zeros = rows.filter("key is null").select("doc_id", *(F.lit("" if c == "groups" else 0).cast("string" if c == "groups" else "long").alias(c) for c in columns[1:]))
    rows = rows.filter("key is not null")
    often = measures.filter(hot)  # fewer than HOT_SHARE rows
    return (zeros.unionByName(rows.join(F.broadcast(often), "key").select(columns))
            .unionByName(rows.join(F.broadcast(often.select("key")), "key", "left_anti").join(measures.filter(~hot), "key").select(columns)))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark, table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("groups", "groups_sha256")
