"""Source divergence audit: how far the word use of each source of a language departs from that of each other source.

Method: count-level bitmaps. The probability of a term in a group depends on the group and the term's count alone, so a group is held as one bitset of
terms for each count that occurs. AND and popcount of two groups' bitsets give the number of terms in each joint cell (count here, count there), which is
multiplied by the cell's divergence; cells with a zero follow by complement from the bitsets' sizes. Terms are dealt into chunks by how frequent they
are, so that the terms of a chunk share few counts, and by hash; chunks are independent and their sums add up. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenix.llm.common import Store, pieces
from provenix.llm.words import LOWER, spans_of, utf8

TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SCALE = 1_000_000_000
CHUNK_TERMS, CHUNK_ROWS = 1024, 500_000


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts (runs of letters A-Z, a-z and characters from U+0080 on; A-Z in lower case) and the text that each is from."""
    data, offsets = utf8(column)
    inside = TERM[data]
    starts, ends = spans_of(inside, offsets)
    at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(LOWER[data[inside]])))
    return terms, np.searchsorted(offsets, starts, side="right") - 1


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term by language and source; null lang, source and text are read as ''."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            terms, text = terms_of(batch.column(2))
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            code, k = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            of_text = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
            pair, times = np.unique(text * k + code, return_counts=True)  # a text's terms, once each
            key = of_text[pair // k] * k + pair % k
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            n, in_docs, key = np.add.reduceat(times[order], first), np.diff(np.r_[first, len(key)]), key[order][first]
            group, term = key // k, key % k
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))), pc.cast(coded.dictionary.take(pa.array(term)), pa.string()), pa.array(n.astype(np.int64)), pa.array(in_docs.astype(np.int64))],
                ["lang", "source", "term", "n", "docs"],
            )

    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), "text")
    return read.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)); the product is a decimal of 31 digits."""
    return F.lit(1) + F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(SCALE), total + kept)


def cell(table: pa.Table) -> pa.Table:
    """One chunk: rows with each term's counts by source, and one row with all sources of the language, their totals and the number of kept terms."""
    kept = table.column("kept").to_numpy()
    head = int(np.flatnonzero(kept >= 0)[0])
    of = table.column("by_source").combine_chunks()
    lang, v, sizes = table.column("lang")[head].as_py(), int(kept[head]), of[head].as_py()
    sizes.sort(key=lambda x: x["source"])
    names, totals = [x["source"] for x in sizes], [x["n"] for x in sizes]
    s = len(names)
    counts = of.filter(pa.array(kept < 0))
    t = len(counts)
    value = np.zeros((s, s), np.int64)
    if t:
        flat = counts.flatten()
        term = np.repeat(np.arange(t), counts.value_lengths().to_numpy())
        source = pc.index_in(flat.field("source"), pa.array(names)).to_numpy(zero_copy_only=False).astype(np.int64)
        n = flat.field("n").to_numpy(zero_copy_only=False)
        order = np.lexsort((n, source))
        new = np.r_[True, (np.diff(source[order]) != 0) | (np.diff(n[order]) != 0)]
        level = np.empty(len(n), np.int64)
        level[order] = np.cumsum(new) - 1
        owner, at = source[order][new], n[order][new]
        bits = np.zeros((len(owner), -(-t // 64) * 64), bool)
        bits[level, term] = True
        sets = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        size = np.bitwise_count(sets).sum(1, dtype=np.int64)
        bound = np.searchsorted(owner, np.arange(s + 1))
        p = np.array([1 + SCALE * (int(c) + 1) // (totals[g] + v) for g, c in zip(owner.tolist(), at.tolist())], np.int64)
        none = np.array([1 + SCALE // (x + v) for x in totals], np.int64)
        by_source = lambda x: np.diff(np.concatenate((np.zeros((*x.shape[:-1], 1), np.int64), np.cumsum(x, axis=-1)), axis=-1)[..., bound], axis=-1)
        apart = lambda p, q: (p - q) * (p - q) // q
        for g in range(s):
            mine = slice(bound[g], bound[g + 1])
            joint = np.zeros((bound[g + 1] - bound[g], len(owner)), np.int64)
            if len(joint):
                for w in range(sets.shape[1]):
                    joint += np.bitwise_count(sets[mine, w, None] & sets[None, :, w])
            only_there = size - joint.sum(0)
            a, b = np.nonzero(joint)
            each = np.zeros(len(owner), np.int64)
            np.add.at(each, b, joint[a, b] * apart(p[mine][a], p[b]))
            each += only_there * apart(none[g], p)
            only_here = size[mine, None] - by_source(joint)
            nowhere = t - size[mine].sum() - by_source(only_there)
            value[g] = by_source(each) + (only_here * apart(p[mine, None], none[None, :])).sum(0) + nowhere * apart(none[g], none)
    g, h = np.nonzero(~np.eye(s, dtype=bool))
    name = pa.array(names, pa.string())
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "source": name.take(pa.array(g)), "item": name.take(pa.array(h)), "value": pa.array(value[g, h])})


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """docs(lang, source, text) -> (lang, source, part, item, value, rank).

    Part ``pair``: each other source of the language with the sum of f over all kept terms; part ``term``: the group's most overused terms against its
    whole language, ranks to ``top``. A term is kept in a language that has it in ``least_docs`` rows or more (repeated rows count each). Nulls are ''.
    A group without terms, or a language without kept terms, has pairs of its own (value 0 if no term is kept) and no terms; a source alone in its
    language has no pairs. Other columns of docs are not read. An empty table gives an empty one.

    The counts of one term by source, and the sources of one language, are gathered together; both are bounded by the number of sources.
    """
    store = Store(docs.sparkSession, "divergence")
    counts = term_counts(docs).groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = store.keep(counts.where(F.col("docs") >= least_docs).select("lang", "term", "total", "by_source", F.length(F.bin("total")).alias("band")))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count(F.lit(1)).alias("kept"))
    each = kept.select("lang", "term", "total", F.inline("by_source"))
    groups = (
        docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
        .join(each.groupBy("lang", "source").agg(F.sum("n").alias("n_group")), ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_group", "n_lang", "kept")))
    )
    groups = store.keep(groups)

    bands = kept.groupBy("lang", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_TERMS), F.ceil(F.sum(F.size("by_source")) / CHUNK_ROWS)).cast("int").alias("chunks"))
    cells = kept.join(bands, ["lang", "band"]).select("lang", "band", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"), F.lit(-1).cast("long").alias("kept"), "by_source")
    whole = groups.groupBy("lang").agg(F.max("kept").alias("kept"), F.collect_list(F.struct("source", F.col("n_group").alias("n"))).alias("by_source"))
    # every chunk learns all sources of its language; one chunk without terms gives languages in which no term is kept their zeros
    heads = whole.join(bands.select("lang", "band", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).unionByName(whole.select("lang", F.lit(-1).alias("band"), F.lit(0).alias("chunk"))), "lang")
    cells = cells.unionByName(heads.select("lang", "band", "chunk", "kept", "by_source"))
    pairs = cells.groupBy("lang", "band", "chunk").applyInArrow(cell, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share(F.col("n"), F.col("n_group"), F.col("kept")), share(F.col("total"), F.col("n_lang"), F.col("kept"))
    terms = each.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda part, df: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked("pair", pairs).unionByName(ranked("term", terms).where(F.col("rank") <= top))


ORACLE = r"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
k as (select lang, term, count(*) total from w group by all having count(distinct id) >= 3),
c as (select lang, source, term, count(*) n from w join k using (lang, term) group by all),
l as (select lang, sum(total) n_lang, count(*) v from k group by all),
g as (select lang, source, coalesce(any_value(n), 0)::hugeint ng, coalesce(any_value(n_lang), 0)::hugeint nl, coalesce(any_value(v), 0)::hugeint v
    from (select distinct lang, source from d) left join (select lang, source, sum(n) n from c group by all) using (lang, source) left join l using (lang) group by all),
p as (select g.lang, g.source, k.term, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (ng + v) p from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source item, coalesce(f.value, 0)::bigint value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
q as (select c.lang, c.source, c.term item, 1 + 1000000000::hugeint * (c.n + 1) // (ng + v) p, 1 + 1000000000::hugeint * (total + 1) // (nl + v) q from c join g using (lang, source) join k on k.lang = c.lang and k.term = c.term),
terms as (select lang, source, item, ((p - q) * (p - q) // q)::bigint value from q where p > q),
every as (select lang, source, 'pair' part, item, value from pairs union all select lang, source, 'term', item, value from terms),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int rank from every)
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 200
"""
