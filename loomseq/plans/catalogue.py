"""All queries of the library but those of the llm subpackage, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.scratch import written
from ..operators import active, assemble, gaps, kmers, links, mapping, model, overlap, pairs, parse, paths, quality, scaffold, stats, unitigs, votes
from ..params import DEFAULT
from ..sources import sinks
from . import views as v

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# --- lines that do not parse ---

_FIELD = r"""(?:"(?:[^"]|"")*"|[^",]*)"""
#: Well-quoted lines are cut into fields: each with its comma before it, quotes taken off and undoubled.
_PARSED = rf"""raw AS (SELECT line_no, line, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*', 's') AS quoted FROM read_raw),
cut AS (SELECT *, CASE WHEN quoted THEN regexp_extract_all(',' || line, ',({_FIELD})', 1, 's') END AS f FROM raw),
fields AS (SELECT line_no, line, quoted, [CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN f] AS f FROM cut),
named AS (SELECT line_no, line, quoted, len(f) AS n, f[1] AS name, f[2] AS seq, f[3] AS qual, f[4] AS len, f[5] AS nb FROM fields),
judged AS (SELECT *, CASE WHEN line IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN n <> 5 THEN 'columns'
 WHEN NOT regexp_full_match(seq, '[ACGTacgtNn.]+') THEN 'seq'
 WHEN qual <> '' AND (length(qual) <> length(seq) OR NOT regexp_full_match(qual, '[!-~]*')) THEN 'qual'
 WHEN NOT regexp_full_match(len, '[0-9]{{1,9}}') OR TRY_CAST(len AS INT) <> length(seq) OR TRY_CAST(len AS INT) > 1023 THEN 'len'
 WHEN NOT regexp_full_match(nb, '[0-9]{{1,9}}') OR TRY_CAST(nb AS INT) <> length(seq) - length(translate(seq, 'Nn.', '')) THEN 'nbasenum' END AS reason FROM named)"""


@_query(f"WITH {_PARSED} SELECT line_no, reason FROM judged WHERE reason IS NOT NULL")
def p3_found(spark, d):
    return parse.rejects(v.table(spark, d, "read_raw"))


@_query(f"WITH {_PARSED} SELECT line_no, name, seq, nullif(qual, '') AS qual, CAST(len AS INT) AS len, CAST(nb AS INT) AS nbasenum FROM judged WHERE reason IS NULL")
def p3_rows(spark, d):
    return parse.typed_rows(v.table(spark, d, "read_raw"))


# --- reads ---


@_query(f"WITH {v.FLAGGED} SELECT rid, valid FROM flagged")
def read_quality(spark, d):
    return quality.flagged(v.reads(spark, d)).select("rid", "valid")


_PROFILE = "SELECT run_id, count(*) AS n_reads, CAST(sum(length(seq)) AS BIGINT) AS n_bases, CAST(max(length(seq)) AS INT) AS max_len, CAST(min(length(seq)) AS INT) AS min_len, CAST({0}(avg(length(seq))) AS BIGINT) AS mean_len FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rid) AS n FROM reads JOIN runs USING (run_id) WHERE file_format = '{1}') WHERE n <= 10000 GROUP BY run_id"


def _profile(spark, d, kind):
    runs = v.table(spark, d, "runs").where(F.col("file_format") == kind).select("run_id")
    return quality.profile(v.reads(spark, d, "run_id", "seq").join(runs, "run_id"), "run_id", "rid", fastq=kind == "fastq")


@_query(f"WITH {v.READS} " + _PROFILE.format("round", "fasta"))
def read_profile_fasta(spark, d):
    return _profile(spark, d, "fasta")


@_query(f"WITH {v.READS} " + _PROFILE.format("ceil", "fastq"))
def read_profile_fastq(spark, d):
    return _profile(spark, d, "fastq")


@_query("SELECT CAST(max(length(seq)) AS INT) AS max_len, CAST(min(length(seq)) AS INT) AS min_len FROM read_buf")
def read_length_range(spark, d):
    return v.table(spark, d, "read_buf").agg(F.max(F.length("seq")).alias("max_len"), F.min(F.length("seq")).alias("min_len"))


@_query(f"WITH {v.VALID} SELECT seq, min(rid) AS first_rid, count(*) AS n_reads FROM good GROUP BY seq")
def read_dictionary(spark, d):
    return quality.distinct_seqs(v.valid(spark, d))


@_query(
    f"""WITH {v.VALID}, cut AS (SELECT rid, seq, CAST(p AS INT) AS pos, substr(seq, CAST(p AS INT), 25) AS w FROM (SELECT *, unnest(range(1, length(seq) + 1, 25)) AS p FROM good))
SELECT rid, pos, reverse(translate(w, 'ACGT', 'TGCA')) AS reverse_seq,
 CAST(list_sum([(strpos('ACGT', substr(w, CAST(i AS INT), 1)) - 1) * (1::BIGINT << CAST(2 * (length(w) - i) AS INT)) FOR i IN range(1, length(w) + 1)]) AS BIGINT) AS packed,
 w AS unpacked,
 CAST(list_reduce([CAST(strpos('ACGT', c) - 1 AS HUGEINT) FOR c IN string_split(w, '')], lambda h, b: (h * 33 + b) % 18446744073709551616, CAST(5381 AS HUGEINT)) % 15728681 AS BIGINT) AS bucket FROM cut"""
)
def sequence_scalars(spark, d):
    """Every read in pieces of 25 bases, the last one shorter."""
    x = v.valid(spark, d).where("seq <> ''").select("rid", "seq", F.explode(F.sequence(F.lit(1), F.length("seq"), F.lit(25))).alias("pos"))
    x = x.select("rid", "pos", F.substring(F.col("seq"), F.col("pos"), F.lit(25)).alias("w"))
    code = bases.pack2(F.col("w"))
    text = F.translate(F.expr("lpad(conv(cast(packed as string), 10, 4), length(w), '0')"), "0123", "ACGT")
    x = x.withColumn("packed", code)
    return x.select("rid", "pos", bases.revcomp(F.col("w")).alias("reverse_seq"), "packed", text.alias("unpacked"), bases.shift_hash(F.col("w"), 15_728_681).alias("bucket"))


@_query(f"WITH {v.READS} SELECT rid, length(seq) - length(translate(seq, 'Nn.', '')) AS n_unknown, translate(seq, 'Nn.', 'CCC') AS replaced, round((length(seq) - length(replace(seq, 'A', ''))) / length(seq), 6) AS share_a FROM reads WHERE seq <> ''")
def unknown_bases(spark, d):
    s = F.col("seq")
    return v.reads(spark, d, "seq").where("seq <> ''").select("rid", bases.unknown_bases(s).cast("bigint").alias("n_unknown"), bases.replace_unknown(s).alias("replaced"), F.round(bases.share_of(s, "A"), 6).alias("share_a"))


# --- k-mers ---


@_query(f"WITH {v.KMERS} SELECT kmer, rid, pos FROM kmers")
def kmer_positions(spark, d):
    return v.sampled(spark, d)


@_query(f"WITH {v.KMERS} SELECT kmer, count(*) AS n, count(DISTINCT rid) AS n_reads FROM kmers GROUP BY kmer")
def kmer_counts(spark, d):
    return kmers.table(v.valid(spark, d)).select("kmer", "n", "n_reads")


@_query(f"WITH {v.KMERS} SELECT kmer, CAST(chunk AS INT) AS chunk, string_agg(rid || ':' || pos, ',' ORDER BY rid, pos) AS postings FROM (SELECT *, (row_number() OVER (PARTITION BY kmer ORDER BY rid, pos) - 1) // 1000 AS chunk FROM kmers) GROUP BY ALL")
def kmer_postings(spark, d):
    p = kmers.postings(v.sampled(spark, d), 1000)
    return p.withColumn("postings", F.array_join(F.transform("postings", lambda x: F.concat_ws(":", x["rid"].cast("string"), x["pos"].cast("string"))), ","))


_BOUNDS = """per AS (SELECT kmer, count(*) AS n, count(DISTINCT rid) AS n_reads, max(CASE WHEN pos = 1 THEN 1 ELSE 0 END) AS at_start FROM kmers GROUP BY kmer),
avgs AS (SELECT greatest(sum(n) / count(*) * 76 / 11 / 1.6, 1.0) AS avg_occ FROM per),
bounds AS (SELECT avg_occ, greatest(least(avg_occ * 0.5, 6), 3) AS lower, avg_occ * 10 AS upper FROM avgs)"""


@_query(f"WITH {v.KMERS}, {_BOUNDS} SELECT round(avg_occ, 6) AS avg_occ, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bounds")
def kmer_bounds(spark, d):
    return kmers.seed_bounds(kmers.table(v.valid(spark, d))).select(*[F.round(c, 6).alias(c) for c in ("avg_occ", "lower", "upper")])


@_query(f"WITH {v.KMERS}, {_BOUNDS} SELECT kmer, n AS multiplicity, n AS arraysize FROM per, bounds WHERE n BETWEEN lower AND upper AND length(replace(kmer, kmer[1], '')) > 0 AND at_start = 1 AND n_reads = n")
def kmer_seeds(spark, d):
    return kmers.seeds(v.valid(spark, d))


@_query(f"WITH {v.KMERS} SELECT kmer, rid, count(*) AS copies FROM kmers GROUP BY kmer, rid HAVING count(*) > 1")
def kmer_multi_copy(spark, d):
    return kmers.multi_copy(v.valid(spark, d))


@_query(f"WITH {v.KMERS} SELECT DISTINCT kmer FROM kmers JOIN good USING (rid) WHERE pos = length(seq) - 24")
def kmer_at_read_end(spark, d):
    return kmers.at_read_end(v.valid(spark, d))


@_query(f"WITH {v.KMERS}, c AS MATERIALIZED (SELECT kmer, count(*) AS n FROM kmers GROUP BY kmer) SELECT a.kmer, a.n, b.n AS n_reverse FROM c a JOIN c b ON b.kmer = reverse(translate(a.kmer, 'ACGT', 'TGCA'))")
def kmer_strands(spark, d):
    return kmers.strand_lookup(kmers.table(v.valid(spark, d)))


@_query(f"WITH {v.KMERS}, {v.UNIQUE} SELECT kmer, count(*) AS arraysize, count(*) FILTER (rid NOT IN (SELECT rid FROM uniq)) AS multiplicity FROM kmers GROUP BY kmer")
def kmer_consumed(spark, d):
    return kmers.consume(v.valid(spark, d), v.unique(spark, d))


# --- placements and mates ---


@_query(f"WITH {v.PLACED} SELECT rid, max(seqlen) AS seqlen, count(*) AS n_places, string_agg(contig_id || ':' || contig_pos, ',' ORDER BY contig_id, contig_pos, orientation, matchlen) AS places FROM placed GROUP BY rid")
def placement_groups(spark, d):
    p = pairs.placement_groups(v.table(spark, d, "match_info"))
    return p.withColumn("places", F.array_join(F.transform("places", lambda x: F.concat_ws(":", x["contig_id"].cast("string"), x["contig_pos"].cast("string"))), ","))


@_query(f"WITH {v.UNIQUE} SELECT rid, contig_id, contig_pos, matchlen, seqlen, orientation, contig_end FROM uniq")
def unique_placements(spark, d):
    return v.unique(spark, d)


@_query(f"WITH {v.MATES} SELECT pair_id, rid_1, rid_2, contig_id_1, contig_id_2 FROM mates")
def mate_pairs(spark, d):
    return pairs.mates(v.unique(spark, d)).select("pair_id", "rid_1", "rid_2", "contig_id_1", "contig_id_2")


@_query(f"WITH {v.FRAGS} SELECT pair_id, contig_id, frag FROM frags")
def fragment_sizes(spark, d):
    return pairs.fragments(v.unique(spark, d))


@_query(f"WITH {v.FRAGS} SELECT count(*) AS n_pairs, round(avg(frag), 6) AS mean_insert, round(stddev_samp(frag), 6) AS sdev_insert FROM frags WHERE frag <= 5000")
def insert_stats(spark, d):
    return pairs.insert_stats(pairs.fragments(v.unique(spark, d))).select("n_pairs", F.round("mean_insert", 6).alias("mean_insert"), F.round("sdev_insert", 6).alias("sdev_insert"))


@_query(f"WITH {v.UNIQUE} SELECT a.contig_id, a.rid AS tail_rid, a.contig_pos AS tail_pos, b.rid, b.contig_pos FROM uniq a JOIN uniq b ON a.contig_id = b.contig_id AND a.rid <> b.rid AND b.orientation = 0 AND a.contig_pos - b.contig_pos BETWEEN 104 AND 224")
def window_partners(spark, d):
    return pairs.window_partners(v.unique(spark, d), 240.0, 20.0, 100, 25)


@_query(
    f"""WITH {v.FLAGGED}, per AS (SELECT rid, max(contig_id) AS c, min(contig_id) AS low, max(coalesce(contig_end, -1)) AS e FROM match_info GROUP BY rid),
x AS (SELECT f.rid, (f.rid + 1) // 2 AS p, coalesce(c, 0) AS c, coalesce(low, 0) AS low, coalesce(e, -1) AS e FROM flagged f LEFT JOIN per USING (rid) WHERE valid),
m AS (SELECT a.rid AS r1, b.rid AS r2, a.c = 0 AND a.low = 0 AS un1, b.c = 0 AND b.low = 0 AS un2, a.c > 0 AND a.e >= 0 AS end1, b.c > 0 AND b.e >= 0 AS end2 FROM x a JOIN x b ON a.p = b.p AND a.rid % 2 = 1 AND b.rid % 2 = 0)
SELECT CASE WHEN un1 AND (end2 OR un2) THEN r1 ELSE r2 END AS rid FROM m WHERE (un1 AND (end2 OR un2)) OR (un2 AND end1)"""
)
def gap_reads(spark, d):
    return pairs.gap_reads(quality.flagged(v.reads(spark, d)), v.table(spark, d, "match_info"))


# --- contig ends and mapping ---

_REGIONS = f"""{v.CONTIGS}, regions AS (
 SELECT contig_id, seq, CASE WHEN clen > 2000 THEN 0 ELSE 2 END AS "end", 1 AS first, CASE WHEN clen > 4000 THEN 2000 WHEN clen > 2000 THEN clen // 2 ELSE clen END AS last FROM ctg
 UNION ALL SELECT contig_id, seq, 1, clen - (CASE WHEN clen > 4000 THEN 2000 ELSE clen // 2 END) + 1, clen FROM ctg WHERE clen > 2000),
ends AS (SELECT * FROM (SELECT contig_id, "end", pos, upper(substr(seq, CAST(pos AS INT), 25)) AS kmer FROM (SELECT *, unnest(range(first, last - 23)) AS pos FROM regions WHERE last - first + 1 >= 25)) WHERE regexp_full_match(kmer, '[ACGT]*'))"""


@_query(f"WITH {_REGIONS} SELECT kmer, count(*) AS n, count(DISTINCT contig_id) AS n_contigs FROM ends GROUP BY kmer")
def contig_end_kmers(spark, d):
    per = mapping.end_kmers(v.contigs(spark, d)).groupBy("code", "contig_id").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("code").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_contigs"))
    return per.select(bases.unpack2(F.col("code"), DEFAULT.k).alias("kmer"), "n", "n_contigs")


@_query(
    f"""WITH {v.VALID}, {_REGIONS}, strands AS (SELECT rid, 0 AS orient, seq FROM good UNION ALL SELECT rid, 1, reverse(translate(seq, 'ACGT', 'TGCA')) FROM good),
offs AS (SELECT rid, orient, seq, length(seq) AS seqlen, list_distinct(list_concat(range(0, length(seq) - 24, 25), [length(seq) - 25])) AS os FROM strands WHERE length(seq) >= 25),
tiles AS (SELECT rid, orient, seqlen, len(os) AS n_tiles, seq, unnest(os) AS off FROM offs),
hits AS (SELECT rid, seqlen, n_tiles, orient, contig_id, pos - off AS pos, max(CASE WHEN off = 0 THEN "end" END) AS "end" FROM tiles t JOIN ends e ON e.kmer = substr(t.seq, CAST(off + 1 AS INT), 25) GROUP BY ALL HAVING count(DISTINCT off) = n_tiles),
c AS (SELECT *, count(*) OVER (PARTITION BY rid) AS total FROM hits)
SELECT rid, contig_id, CAST(pos AS INT) AS pos, orient, "end", CAST(seqlen AS INT) AS seqlen FROM c WHERE total = 1"""
)
def read_mapping(spark, d):
    return mapping.map_unique(v.valid(spark, d), v.contigs(spark, d))


@_query(f"WITH {v.UNIQUE} SELECT contig_id, contig_end, CAST(row_number() OVER (PARTITION BY contig_id, contig_end ORDER BY contig_pos, rid) AS INT) AS ord, contig_pos, rid FROM uniq WHERE contig_end >= 0")
def contig_end_reads(spark, d):
    return mapping.end_reads(v.unique(spark, d))


@_query(
    f"""WITH {v.UNIQUE}, {_REGIONS}, per AS (SELECT contig_id, contig_end, count(*) AS n FROM uniq WHERE contig_end >= 0 GROUP BY ALL),
x AS (SELECT r.contig_id, r."end", coalesce(n, 0) AS n_reads, last - first + 1 AS region FROM regions r LEFT JOIN per ON r.contig_id = per.contig_id AND r."end" = contig_end),
m AS (SELECT sum(n_reads) / sum(region) AS cov FROM x WHERE "end" < 2) SELECT contig_id, "end", n_reads, CAST(region AS INT) AS region, round(n_reads / region / cov, 6) AS ratio FROM x, m"""
)
def end_coverage(spark, d):
    return mapping.end_coverage(v.unique(spark, d), v.contigs(spark, d)).withColumn("ratio", F.round("ratio", 6))


_BINS = "bins AS (SELECT contig_id, contig_end, (contig_pos - 1) // 30 AS bin, count(*) AS n_reads FROM uniq WHERE contig_end >= 0 GROUP BY ALL)"


@_query(f"WITH {v.UNIQUE}, {_BINS} SELECT contig_id, contig_end, CAST(bin AS BIGINT) AS bin, n_reads, round(avg(n_reads) OVER w, 6) AS mean_reads, lag(n_reads) OVER (w ORDER BY bin) AS before FROM bins WINDOW w AS (PARTITION BY contig_id, contig_end)")
def coverage_bins(spark, d):
    return mapping.coverage_bins(v.unique(spark, d)).withColumn("mean_reads", F.round("mean_reads", 6))


@_query()
def coverage_bins_dropped(spark, d):
    """Bins that fall to the coverage rule, with the partner contigs of the mates in each bin."""
    u = v.half_placements(spark, d)
    return mapping.filter_bins(mapping.coverage_bins(u), mapping.bin_links(links.end_pairs(u)))


@_query(f"WITH {v.UNIQUE}, {v.CONTIGS}, per AS (SELECT contig_id, min(contig_pos) AS lo, max(contig_pos + seqlen - 1) AS hi FROM uniq GROUP BY contig_id) SELECT contig_id, CAST(coalesce(lo - 1, clen) AS INT) AS bare5, CAST(coalesce(greatest(clen - hi, 0), clen) AS INT) AS bare3 FROM ctg LEFT JOIN per USING (contig_id)")
def uncovered_ends(spark, d):
    return mapping.uncovered_end(v.unique(spark, d), v.contigs(spark, d))


@_query(
    f"""WITH {v.UNIQUE}, {v.CONTIGS} SELECT rid, contig_id, CASE WHEN clen <= 2000 THEN 2 WHEN clen <= 4000 THEN CASE WHEN contig_pos + seqlen - 1 <= clen // 2 THEN 0 WHEN contig_pos > clen - clen // 2 THEN 1 ELSE -1 END
 WHEN contig_pos + seqlen - 1 <= 2000 THEN 0 WHEN contig_pos > clen - 2000 THEN 1 ELSE -1 END AS end_class FROM uniq JOIN ctg USING (contig_id)"""
)
def placement_ends(spark, d):
    return mapping.classify_end(v.unique(spark, d), v.contigs(spark, d)).select("rid", "contig_id", "end_class")


# --- links ---


@_query(f"WITH {v.LINKS} SELECT c1, e1, c2, e2, CAST(count(*) FILTER (s = 0) AS INT) AS n0, CAST(count(*) FILTER (s = 1) AS INT) AS n1, CAST(count(*) FILTER (s = 2) AS INT) AS n2, CAST(count(*) FILTER (s = 3) AS INT) AS n3 FROM links GROUP BY c1, e1, c2, e2 HAVING count(s) > 0")
def edges_counted(spark, d):
    return links.edges(links.end_pairs(v.half_placements(spark, d)))


@_query(f"WITH {v.RANKED} SELECT c1, e1, c2, e2, best, n_best, second, n_second FROM ranked")
def edge_ranks(spark, d):
    return links.ranked(links.clean(v.table(spark, d, "contig_edges"))).select("c1", "e1", "c2", "e2", "best", "n_best", "second", "n_second")


@_query(
    f"""WITH {v.LINKS}, x AS (SELECT l.*, CASE WHEN s IN (0, 1) THEN a.clen - pos1 + 1 ELSE pos1 + len1 - 1 END AS b1, CASE WHEN s IN (0, 3) THEN pos2 + len2 - 1 ELSE b.clen - pos2 + 1 END AS b2
 FROM links l JOIN ctg a ON a.contig_id = c1 JOIN ctg b ON b.contig_id = c2 WHERE s IS NOT NULL)
SELECT c1, e1, c2, e2, s, count(*) AS n_pairs, round(avg(CAST(trunc(240.0 - b1 - b2) AS INT)), 6) AS gap FROM x GROUP BY c1, e1, c2, e2, s"""
)
def edge_gaps(spark, d):
    return links.gap_sizes(links.end_pairs(v.half_placements(spark, d)), v.half_contigs(spark, d), 240.0).withColumn("gap", F.round("gap", 6))


def _ranked(spark, d):
    return links.ranked(links.clean(v.table(spark, d, "contig_edges")))


@_query(f"WITH {v.RANKED}, x AS (SELECT *, row_number() OVER (PARTITION BY c1, e1 ORDER BY n_best DESC, c2, e2) AS rank FROM ranked) SELECT c1, e1, c2, e2, n_best, CAST(rank AS INT) AS rank FROM x WHERE rank <= 2")
def edge_top2(spark, d):
    return links.top2(_ranked(spark, d)).select("c1", "e1", "c2", "e2", "n_best", "rank")


@_query(f"WITH {v.RANKED}, x AS (SELECT coalesce(sum(n_best), 0) // 2 AS p, count(*) // 2 AS e FROM ranked WHERE e1 <> 1), y AS (SELECT CASE WHEN e > 0 THEN p / e ELSE 0.0 END AS a FROM x) SELECT round(a, 6) AS avg_links, round(a * 13, 6) AS max_links, round(least(a * 0.1, 3), 6) AS min_links, 1 AS max_second FROM y")
def link_thresholds(spark, d):
    return links.thresholds(_ranked(spark, d)).select(*[F.round(c, 6).alias(c) for c in ("avg_links", "max_links", "min_links")], "max_second")


@_query(f"WITH {v.RANKED}, x AS (SELECT coalesce(avg(CASE WHEN n_best = 1 THEN 1 ELSE 0 END), 0) AS s FROM ranked) SELECT round(s, 6) AS single_share, CASE WHEN s > 0.1 THEN 1 ELSE 2 END AS min_pairs FROM x")
def link_min_pairs(spark, d):
    return links.min_pairs(_ranked(spark, d)).withColumn("single_share", F.round("single_share", 6))


@_query(f"WITH {v.RANKED}, x AS (SELECT *, row_number() OVER (PARTITION BY c1, e1 ORDER BY n_best DESC, c2, e2) AS rank FROM ranked), o AS (SELECT *, max(n_best) FILTER (rank > 1) OVER (PARTITION BY c1, e1) AS other FROM x) SELECT c1, e1, c2, e2, n_best FROM o WHERE rank = 1 AND coalesce(other, 0) <= n_best * 0.1")
def single_links(spark, d):
    return links.single_links(_ranked(spark, d)).select("c1", "e1", "c2", "e2", "n_best")


def _coverage(spark, d):
    c = v.table(spark, d, "contigs")
    return c.select("contig_id", F.greatest(F.when(~F.isnan("cov_end5"), F.col("cov_end5")), F.when(~F.isnan("cov_end3"), F.col("cov_end3"))).alias("cov"))


@_query(f"WITH {v.RANKED}, c AS (SELECT contig_id, greatest(cov_end5, cov_end3) AS cov FROM contigs) SELECT c1, e1, c2, e2, n_best FROM ranked LEFT JOIN c a ON a.contig_id = c1 LEFT JOIN c b ON b.contig_id = c2 WHERE NOT coalesce(gap < -500 OR (gap < -200 AND greatest(coalesce(a.cov, 0), coalesce(b.cov, 0)) > 2), false)")
def sane_links(spark, d):
    return links.sane(_ranked(spark, d), _coverage(spark, d)).select("c1", "e1", "c2", "e2", "n_best")


@_query(f"WITH {v.LINKS}, n AS (SELECT c1, e1, c2, count(*) AS n FROM links GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY c1, e1 ORDER BY n DESC, c2) AS INT) AS rank FROM n) SELECT * FROM r WHERE rank <= 2")
def linked_contigs(spark, d):
    return links.linked_contigs(links.end_pairs(v.half_placements(spark, d)))


@_query(
    f"""WITH {v.LINKS}, x AS (SELECT l.c1, l.e1, l.c2, l.e2, CASE WHEN e1 = 1 THEN a.clen - pos1 + 1 ELSE pos1 END BETWEEN 38 AND 2000 AND CASE WHEN e2 = 1 THEN b.clen - pos2 + 1 ELSE pos2 END BETWEEN 38 AND 2000 AS ok FROM links l JOIN ctg a ON a.contig_id = c1 JOIN ctg b ON b.contig_id = c2)
SELECT c1, e1, c2, e2, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_other FROM x GROUP BY ALL"""
)
def qualified_pairs(spark, d):
    return links.qualified_pairs(links.end_pairs(v.half_placements(spark, d)), v.half_contigs(spark, d), 25, 2000)


# --- votes ---


def _placed_seqs(spark, d):
    return votes.oriented(v.unique(spark, d), v.reads(spark, d, "seq"))


def _votes(seqs, mated=None):
    return votes.next_base_votes(seqs, mated, one_row_a_read=True)


@_query(f"WITH {v.PILE} SELECT * FROM votes")
def base_votes(spark, d):
    return _votes(_placed_seqs(spark, d))


@_query(f"WITH {v.PILE}, mated AS (SELECT a.rid FROM uniq a JOIN uniq b ON b.rid = a.rid + CASE WHEN a.rid % 2 = 1 THEN 1 ELSE -1 END AND a.contig_id = b.contig_id) SELECT contig_id, pos, count(*) FILTER (base = 'A') AS n_A, count(*) FILTER (base = 'C') AS n_C, count(*) FILTER (base = 'G') AS n_G, count(*) FILTER (base = 'T') AS n_T FROM bases WHERE rid IN (SELECT rid FROM mated) GROUP BY contig_id, pos")
def base_votes_paired(spark, d):
    m = pairs.mates(v.unique(spark, d)).where("contig_id_1 = contig_id_2").select(F.explode(F.array("rid_1", "rid_2")).alias("rid"))
    return _votes(_placed_seqs(spark, d), m)


@_query(f"WITH {v.PILE} SELECT * FROM winners")
def base_winners(spark, d):
    return votes.winners(_votes(_placed_seqs(spark, d)))


@_query(f"WITH {v.PILE} SELECT contig_id, count(*) AS n_columns, count(*) FILTER ((total >= 10 AND n_max / total < 0.9) OR (total < 10 AND n_second > 0 AND n_max / n_second < 4)) AS n_incorrect FROM winners GROUP BY contig_id")
def incorrect_columns(spark, d):
    return votes.incorrect_columns(votes.winners(_votes(_placed_seqs(spark, d))))


@_query(f"WITH {v.PILE} SELECT rid, contig_id, CAST(pos AS INT) AS pos, second AS base, w.base AS corrected FROM bases b JOIN winners w USING (contig_id, pos) WHERE total >= 3 AND n_second = 1 AND b.base = second")
def corrected_bases(spark, d):
    s = _placed_seqs(spark, d)
    return votes.corrected(s, votes.winners(_votes(s)), 3)


_HAM = "len([1 FOR i IN range(1, {n} + 1) IF substr({a}, CAST(i AS INT), 1) <> substr({b}, CAST(i AS INT), 1)])"


def _shift_sql() -> str:
    out = []
    for kind, shift in ((k, s) for k in (1, 2) for s in range(11)):
        a, b = (f"substr(a, {shift + 1})", "b") if kind == 1 else ("a", f"substr(b, {shift + 1})")
        n = f"least(length({a}), length({b}))"
        ham = _HAM.format(a=a, b=b, n=n)
        out.append(f"WHEN {n} > 0 AND {ham} <= 1 THEN ({shift}, {kind}, {ham})")
    return "CASE " + " ".join(out) + " END"


@_query(
    f"""WITH {v.ACROSS}, x AS (SELECT rid, tail AS a, lag(tail) OVER (PARTITION BY contig_id ORDER BY rid) AS b FROM across),
y AS (SELECT rid, {_shift_sql()} AS s FROM x WHERE b IS NOT NULL) SELECT rid, CAST(s[1] AS INT) AS shift, CAST(s[2] AS INT) AS kind, CAST(s[3] AS INT) AS mismatches FROM y"""
)
def shift_distances(spark, d):
    """What each read across the middle of a contig says beyond it, shifted against what the read before it says."""
    from pyspark.sql import Window

    x = _across(spark, d).select("rid", F.col("tail").alias("a"), F.lag("tail").over(Window.partitionBy("contig_id").orderBy("rid")).alias("b")).where("b is not null")
    return x.withColumn("s", votes.shift_distance(F.col("a"), F.col("b"))).select("rid", "s.shift", "s.kind", "s.mismatches")


def _mated(spark, d):
    return pairs.mates(v.unique(spark, d)).where("contig_id_1 = contig_id_2").select(F.explode(F.array("rid_1", "rid_2")).alias("rid"))


def _state(spark, d):
    """Votes of all reads and of mated ones at every position, with bare tail and density."""
    seqs = written(_placed_seqs(spark, d), "placed-seqs")
    se = votes.winners(_votes(seqs)).select("contig_id", "pos", F.col("n_max").alias("se_max"), F.col("n_second").alias("se_sec"))
    pe = votes.winners(_votes(seqs, _mated(spark, d))).select("contig_id", "pos", F.col("n_max").alias("pe_max"), F.col("n_second").alias("pe_sec"))
    x = se.join(pe, ["contig_id", "pos"], "left").fillna(0, ["pe_max", "pe_sec"])
    return active.tail_state(x, v.unique(spark, d), v.contigs(spark, d), 100)


def _kernel_sql(model: votes.KernelModel, f: str) -> str:
    """Score of the polynomial kernel over the list f."""
    scaled = [f"({k} * ({f}[{i + 1}] + ({s})))" for i, (s, k) in enumerate(zip(model.shift, model.factor))]
    out = []
    for a, vec in zip(model.alpha, model.vectors):
        dot = "(" + " + ".join(f"({x}) * {y}" for x, y in zip(vec, scaled)) + ")"
        out.append(f"({a}) * {dot} * (1 + {dot}) * (1 + {dot})")
    return " + ".join([f"({model.bias})", *out])


_SCORED = f"""{v.STATE}, scored AS (SELECT *, {_kernel_sql(model.PAIRED, "[CAST(pe_max AS DOUBLE), CAST(pe_sec AS DOUBLE), ratio, CAST(tail AS DOUBLE)]")} AS score FROM state)"""


def _scored(spark, d):
    f = F.array(*[F.col(c).cast("double") for c in ("pe_max", "pe_sec", "ratio", "tail")])
    return _state(spark, d).withColumn("score", votes.decision_score(f, model.PAIRED))


@_query(f"WITH {_SCORED} SELECT contig_id, pos, round(score, 4) AS score, score < 0 AS extend FROM scored WHERE abs(score) > 0.000001")
def kernel_scores(spark, d):
    """The scorer over votes of mates, read density and bare tail at every position."""
    return _scored(spark, d).where("abs(score) > 0.000001").select("contig_id", "pos", F.round("score", 4).alias("score"), (F.col("score") < 0).alias("extend"))


_MODEL = votes.KernelModel(((0.5, 0.1, 0.2, 0.3), (0.1, 0.4, 0.3, 0.2), (0.2, 0.2, 0.9, 0.1)), (1.5, -2.0, 0.75), -0.25, (1.0, 1.0, 1.0, 1.0), (0.5, 0.5, 0.5, 0.5))


def _kinds_sql(kind: str) -> str:
    out = []
    for a, vec in zip(_MODEL.alpha, _MODEL.vectors):
        dot = "(" + " + ".join(f"{x} * f[{i + 1}]" for i, x in enumerate(vec)) + ")"
        dist = "(" + " + ".join(f"({x} - f[{i + 1}]) * ({x} - f[{i + 1}])" for i, x in enumerate(vec)) + ")"
        out.append(f"{a} * " + {"linear": dot, "rbf": f"exp(-0.5 * {dist})", "polynomial": f"{dot} * (1 + {dot}) * (1 + {dot})"}[kind])
    return " + ".join([str(_MODEL.bias), *out])


@_query("WITH x AS (SELECT vec_id, [0.5 * (CAST(e AS DOUBLE) + 1.0) FOR e IN embedding[1:4]] AS f FROM embeddings) SELECT vec_id, " + ", ".join(f"round({_kinds_sql(k)}, 6) AS {k}" for k in ("linear", "rbf", "polynomial")) + " FROM x")
def kernel_kinds(spark, d):
    """The three kernels over vectors of four numbers."""
    f = F.transform(F.slice("embedding", 1, 4), lambda e: e.cast("double"))
    return v.table(spark, d, "embeddings").select("vec_id", *[F.round(votes.decision_score(f, _MODEL, k), 6).alias(k) for k in ("linear", "rbf", "polynomial")])


@_query(
    f"""WITH {_SCORED}, h AS (SELECT key AS contig_id, n_paths, n_max AS path_max, n_second AS path_second FROM (WITH {v.PATHS} SELECT h.*, n_paths FROM heads h JOIN (SELECT key, count(*) AS n_paths FROM ways GROUP BY key) USING (key))),
x AS (SELECT s.*, coalesce(n_paths, 0) AS n_paths, coalesce(path_max, 0) AS path_max, coalesce(path_second, 0) AS path_second FROM scored s LEFT JOIN h USING (contig_id))
SELECT contig_id, pos,
 CASE WHEN tail > 30 OR ratio < 0.03 THEN false WHEN pos < 80 AND n_paths >= 2 AND path_max < 3 * path_second THEN false WHEN se_sec > 0 AND score >= 0 THEN false
  WHEN se_sec > 0 AND (se_max - se_sec < 2 OR se_sec > 4 OR (se_sec >= 2 AND se_sec / se_max >= 0.6)) THEN false WHEN se_max = 0 THEN false ELSE true END AS single,
 CASE WHEN (ratio < 0.03 AND n_paths >= 2) OR (n_paths >= 2 AND tail > 50 AND ratio < 0.4 AND pe_max <= 5) OR pe_max = 0 THEN false
  WHEN pe_sec > 0 THEN CASE WHEN pe_max / pe_sec >= 3 THEN true WHEN pe_sec / pe_max >= 0.25 AND pe_max < 1.2 THEN false ELSE score < 0 END ELSE true END AS paired
 FROM x WHERE abs(score) > 0.000001"""
)
def extension_gate(spark, d):
    """Both decision cascades at every position: votes, tail, density and score there, candidate paths of the contig."""
    h = paths.candidate_paths(_across(spark, d).select(F.col("contig_id").alias("key"), "tail")).where("path_no = 1")
    h = h.select(F.col("key").alias("contig_id"), "n_paths", F.col("n_max").alias("path_max"), F.col("n_second").alias("path_second"))
    x = _scored(spark, d).join(h, "contig_id", "left").fillna(0, ["n_paths", "path_max", "path_second"]).where("abs(score) > 0.000001")
    x = x.withColumns({"navi": F.lit(0), "length": F.col("pos")})
    single = x.withColumns({"n_max": F.col("se_max"), "n_second": F.col("se_sec")}).withColumn("single", votes.single_end_gate(100, 4.0))
    both = single.withColumns({"n_max": F.col("pe_max"), "n_second": F.col("pe_sec")}).withColumn("paired", votes.paired_gate(4.0))
    return both.select("contig_id", "pos", "single", "paired")


@_query(
    f"""WITH {v.PATHS}, x AS (SELECT h.*, n_incorrect, (SELECT count(*) FROM ways w WHERE w.key = h.key) AS n_paths FROM heads h JOIN wrong USING (key))
SELECT key, CASE WHEN n_incorrect > 3 THEN false WHEN (n_second / n_max > 0.7 AND n_incorrect > 1 AND total > 10) OR (n_max / total < 0.6 AND n_incorrect > 2) THEN false ELSE true END AS by_paths,
 CASE WHEN n_paths = 1 THEN true WHEN n_incorrect > 3 THEN false WHEN n_second / n_max > 0.8 AND n_incorrect > 1 AND total > 10 THEN false WHEN n_second / n_max > 0.7 AND n_incorrect > 2 THEN false ELSE true END AS by_tandem FROM x"""
)
def path_decisions(spark, d):
    """The decisions over the candidate paths at the middle of each contig."""
    x = paths.candidate_paths(_across(spark, d).select(F.col("contig_id").alias("key"), "tail")).where("path_no = 1")
    return x.select("key", votes.path_decision().alias("by_paths"), votes.tandem_decision().alias("by_tandem"))


# --- statistics and windows ---


@_query(
    """WITH x AS (SELECT CAST(len AS BIGINT) AS l FROM contigs WHERE len >= 0), o AS (SELECT l, row_number() OVER (ORDER BY l DESC) AS r, sum(l) OVER (ORDER BY l DESC ROWS UNBOUNDED PRECEDING) AS run FROM x), t AS (SELECT count(*) AS n, sum(l) AS total FROM x)
SELECT n, CAST(total AS BIGINT) AS total, max(l) AS max_len, max(l) FILTER (run >= total // 2) AS n50, round(total / n, 6) AS mean_len, max(l) FILTER (r = n // 2 + 1) AS median_len FROM o, t GROUP BY n, total"""
)
def length_stats(spark, d):
    return stats.length_stats(v.table(spark, d, "contigs")).withColumn("mean_len", F.round("mean_len", 6))


@_query(
    f"""WITH {v.UNIQUE}, {v.CONTIGS}, x AS (SELECT contig_id, contig_pos + seqlen - 1 AS pos, count(*) AS n FROM uniq GROUP BY ALL),
y AS (SELECT *, CAST(sum(n) OVER (PARTITION BY contig_id ORDER BY pos RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) AS BIGINT) AS region_reads, sum(n) OVER (PARTITION BY contig_id) AS total FROM x)
SELECT contig_id, pos, region_reads, round(region_reads * clen / (total * least(100, clen)), 6) AS ratio FROM y JOIN ctg USING (contig_id)"""
)
def density_ratio(spark, d):
    return stats.density_ratio(v.unique(spark, d), v.contigs(spark, d), 100).withColumn("ratio", F.round("ratio", 6))


@_query(
    f"""WITH {v.UNIQUE}, {v.CONTIGS}, s AS (SELECT contig_id, clen, greatest(1, clen - 149) AS first FROM ctg),
p AS (SELECT DISTINCT contig_id, contig_pos + seqlen - 1 AS pos FROM uniq UNION ALL SELECT contig_id, clen + 1 FROM ctg),
x AS (SELECT p.*, first, clen FROM p JOIN s USING (contig_id) WHERE pos BETWEEN first AND clen + 1)
SELECT contig_id, CAST(max(run) AS INT) AS longest_run FROM (SELECT contig_id, pos - coalesce(lag(pos) OVER (PARTITION BY contig_id ORDER BY pos), first - 1) - 1 AS run FROM x) GROUP BY contig_id"""
)
def uncovered_runs(spark, d):
    return stats.uncovered_runs(v.unique(spark, d), v.contigs(spark, d), 100)


@_query(
    f"""WITH {v.STATE}, x AS (SELECT contig_id, pos, pe_max = 0 AND se_max = 1 AS single, pe_max > 0 AS pe, pe_sec + se_sec >= 0.6 * (pe_max + se_max) AND pe_sec + se_sec > 0 AS amb FROM state),
y AS (SELECT contig_id, pos, count(*) FILTER (single) OVER (PARTITION BY contig_id ORDER BY pos RANGE BETWEEN 29 PRECEDING AND CURRENT ROW) AS c30_single, count(*) FILTER (pe) OVER (PARTITION BY contig_id ORDER BY pos RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS c50_pe,
 count(*) FILTER (amb) OVER (PARTITION BY contig_id ORDER BY pos RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) AS c100_ambiguous FROM x)
SELECT *, c30_single >= 30 OR c100_ambiguous >= 3 AS stop FROM y"""
)
def tail_guards(spark, d):
    return stats.tail_guards(_state(spark, d))


# --- overlaps, chains, scaffolds, assembly ---

_ENDS = f"""{v.RANKED}, {v.CONTIGS}, o AS (SELECT r.*, CASE WHEN best IN (2, 3) THEN reverse(translate(upper(a.seq), 'ACGT', 'TGCA')) ELSE upper(a.seq) END AS l, CASE WHEN best IN (1, 2) THEN reverse(translate(upper(b.seq), 'ACGT', 'TGCA')) ELSE upper(b.seq) END AS s
 FROM ranked r JOIN ctg a ON a.contig_id = c1 JOIN ctg b ON b.contig_id = c2)"""


@_query(
    f"""WITH {_ENDS}, x AS (SELECT c1, e1, c2, e2, coalesce(gap, 0) AS g, l, s, unnest(range(2, least(200, length(l), length(s)) + 1)) AS i FROM o),
h AS (SELECT *, row_number() OVER (PARTITION BY c1, e1, c2, e2 ORDER BY abs(i + g), i DESC) AS r FROM x WHERE right(l, CAST(i AS INT)) = left(s, CAST(i AS INT)))
SELECT o.c1, o.e1, o.c2, o.e2, CAST(coalesce(i, 0) AS INT) AS overlap FROM o LEFT JOIN h ON h.r = 1 AND h.c1 = o.c1 AND h.e1 = o.e1 AND h.c2 = o.c2 AND h.e2 = o.e2"""
)
def exact_overlaps(spark, d):
    return _edge_seqs(spark, d).select("c1", "e1", "c2", "e2", overlap.exact_overlap(F.col("l"), F.col("r"), F.col("g"), 200).alias("overlap"))


def _edge_seqs(spark, d, reach=200):
    """Edges with the end of the left contig (l) and the start of the right one (r), both turned as they lie: `reach` bases each."""
    c = v.contigs(spark, d).select("contig_id", F.upper("seq").alias("seq"))
    tips = c.select("contig_id", F.expr(f"right(seq, {reach})").alias("last"), F.expr(f"left(seq, {reach})").alias("first"))
    a, b = (tips.select(F.col("contig_id").alias(f"c{i}"), F.col("last").alias(f"last{i}"), F.col("first").alias(f"first{i}")) for i in (1, 2))
    x = _ranked(spark, d).join(a, "c1").join(b, "c2")
    left = F.when(F.col("best").isin(2, 3), bases.revcomp(F.col("first1"))).otherwise(F.col("last1"))
    right = F.when(F.col("best").isin(1, 2), bases.revcomp(F.col("last2"))).otherwise(F.col("first2"))
    g = F.coalesce(F.when(~F.isnan("gap"), F.col("gap")), F.lit(0.0))
    return x.withColumn("l", left).withColumn("r", right).withColumn("g", g)


@_query()
def aligned_overlaps(spark, d):
    x = _edge_seqs(spark, d).withColumn("a", overlap.dovetail(F.expr("right(l, 200)"), F.expr("left(r, 200)")))
    exact = overlap.exact_overlap(F.col("l"), F.col("r"), F.col("g"), 200)
    bare = mapping.uncovered_end(v.unique(spark, d), v.contigs(spark, d))
    for side in "12":
        x = x.join(bare.select(F.col("contig_id").alias(f"c{side}"), F.col("bare5").alias(f"five{side}"), F.col("bare3").alias(f"three{side}")), f"c{side}", "left")
    left = F.when(F.col("best").isin(2, 3), F.col("five1")).otherwise(F.col("three1"))
    right = F.when(F.col("best").isin(1, 2), F.col("three2")).otherwise(F.col("five2"))
    cut = overlap.cut_retry(F.expr("right(l, 200)"), F.expr("left(r, 200)"), left, right, F.col("g"), 100)
    return x.withColumn("exact", exact).select("c1", "e1", "c2", "e2", "exact", F.col("a.overlap").alias("aligned"), F.col("a.mismatches").alias("mismatches"), cut["round"].alias("cut_round"), overlap.decide(F.col("g"), F.col("n_best"), 20.0, F.col("exact"), F.col("a.overlap"), F.col("a.mismatches")).alias("decision"))


def _chain(spark, d):
    return scaffold.link(links.sane(_ranked(spark, d), _coverage(spark, d)), v.contigs(spark, d))


@_query(
    f"""WITH RECURSIVE {v.RANKED}, {v.CONTIGS}, cv AS (SELECT contig_id, max(greatest(cov_end5, cov_end3)) AS cov FROM contigs GROUP BY contig_id),
sane AS (SELECT CAST(c1 AS BIGINT) AS c1, CAST(c2 AS BIGINT) AS c2, best, n_best, n_second, gap FROM ranked LEFT JOIN cv a ON a.contig_id = c1 LEFT JOIN cv b ON b.contig_id = c2
 WHERE n_best > 0 AND c1 <> c2 AND NOT coalesce(gap < -500 OR (gap < -200 AND greatest(coalesce(a.cov, 0), coalesce(b.cov, 0)) > 2), false)),
turned AS (SELECT * FROM sane UNION ALL SELECT c2, c1, CASE best WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE best END, n_best, n_second, gap FROM sane),
strands AS (SELECT 2 * c1 + CAST(best IN (2, 3) AS BIGINT) AS src, 2 * c2 + CAST(best IN (1, 2) AS BIGINT) AS dst, max(n_best) AS n_pairs, min(n_second) AS n_second, min(gap) AS gap FROM turned
 WHERE c1 IN (SELECT contig_id FROM ctg) AND c2 IN (SELECT contig_id FROM ctg) GROUP BY c1, c2, best),
firsts AS (SELECT *, greatest(n_second, coalesce(next, 0)) AS rival FROM (SELECT *, row_number() OVER w AS rn, lead(n_pairs) OVER w AS next FROM strands WINDOW w AS (PARTITION BY src ORDER BY n_pairs DESC, dst)) WHERE rn = 1),
clear AS (SELECT * FROM firsts WHERE rival <= n_pairs * 0.4),
links AS MATERIALIZED (SELECT a.src, a.dst, a.gap, a.n_pairs, a.rival <= 0.1 * a.n_pairs AND m.rival <= 0.1 * m.n_pairs AS alone FROM clear a JOIN clear m ON m.src = xor(a.dst, 1) AND m.dst = xor(a.src, 1)),
walk(head, node, place, gap, n_pairs, alone) AS (SELECT DISTINCT src, src, 1, CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(NULL AS BOOLEAN) FROM links WHERE src NOT IN (SELECT dst FROM links)
 UNION ALL SELECT head, dst, place + 1, l.gap, CAST(l.n_pairs AS BIGINT), l.alone FROM walk JOIN links l ON l.src = node),
full_ AS (SELECT w.*, node // 2 AS contig_id, CAST(node % 2 AS INT) AS orient, clen FROM walk w JOIN ctg ON contig_id = node // 2),
per AS (SELECT head, min(contig_id) AS scaffold_id FROM full_ GROUP BY head HAVING arg_max(orient, (clen, -contig_id, -orient)) = 0 AND count(*) = count(DISTINCT contig_id) AND bool_or(alone))
SELECT scaffold_id, CAST(place AS INT) AS ord, contig_id, orient, gap, n_pairs FROM full_ JOIN per USING (head)"""
)
def chains(spark, d):
    return _chain(spark, d)


def _rows(spark, d):
    bare = mapping.uncovered_end(v.unique(spark, d), v.contigs(spark, d))
    return written(overlap.neighbour_overlaps(written(_chain(spark, d), "chain"), v.contigs(spark, d), 20.0, bare=bare), "chain-rows")


@_query()
def chain_overlaps(spark, d):
    return _rows(spark, d)


@_query()
def weak_links(spark, d):
    return scaffold.weak_links(_rows(spark, d), v.contigs(spark, d), _ranked(spark, d).select("c1", "c2"))


@_query()
def scaffolds(spark, d):
    rows = _rows(spark, d)
    return scaffold.with_unlinked(scaffold.scaffold_seqs(rows, v.contigs(spark, d)), rows, v.contigs(spark, d))


@_query()
def merged_contigs(spark, d):
    rows = _rows(spark, d).where("true")
    merge = rows.withColumn("decision", F.when(F.col("decision") == "gap", "break").otherwise(F.col("decision")))
    return scaffold.merged_contigs(scaffold.scaffold_seqs(merge, v.contigs(spark, d)), merge, v.contigs(spark, d))


@_query()
def read_components(spark, d):
    return assemble.read_components(v.valid(spark, d).where("length(seq) >= 40"))


@_query()
def assembled_contigs(spark, d):
    return assemble.assemble(v.valid(spark, d)).select("component", "contig_no", "seq", "n_reads")


@_query()
def unitig_paths(spark, d):
    return unitigs.unitigs(v.valid(spark, d))


@_query()
def unitig_contigs(spark, d):
    return unitigs.assemble(v.valid(spark, d))


@_query()
def filled_gaps(spark, d):
    """Gaps between neighbours of a chain, filled from both sides by reads placed near them and their mates."""
    t = written(gaps.gap_table(_rows(spark, d), v.contigs(spark, d)), "gaps")
    return assemble.fill_gaps(t.join(gaps.near_reads(t, v.unique(spark, d), v.valid(spark, d)), "gap_id", "left"), sdev=20.0)


@_query(f"WITH {v.UNIQUE} SELECT contig_id, bool_or(matchlen >= 80) AS has_long FROM uniq GROUP BY contig_id")
def long_placements(spark, d):
    return active.any_long_success(v.unique(spark, d), 100)


@_query(f"WITH {v.FRAGS} SELECT contig_id, count(*) AS n_pairs, round(avg(frag), 6) AS mean_frag FROM frags GROUP BY contig_id")
def mean_fragments(spark, d):
    return paths.mean_fragments(pairs.fragments(v.unique(spark, d))).withColumn("mean_frag", F.round("mean_frag", 6))


@_query(f"WITH {v.KMERS}, {v.CONTIGS}, tips AS (SELECT contig_id, upper(right(seq, 25)) AS kmer FROM ctg WHERE clen >= 25) SELECT contig_id, kmer, rid, pos FROM tips JOIN kmers USING (kmer)")
def kmer_lookup(spark, d):
    """Postings of the last k-mer of each contig: the reads that could extend it."""
    tips = v.contigs(spark, d).where("length(seq) >= 25").select("contig_id", F.upper(F.expr("right(seq, 25)")).alias("kmer"))
    return tips.join(v.sampled(spark, d), "kmer").select("contig_id", "kmer", "rid", "pos")


@_query(
    f"""WITH {v.KMERS}, {v.UNIQUE}, {v.CONTIGS}, due AS (SELECT contig_id, rid, p.pos, upper(substr(c.seq, CAST(contig_pos + p.pos - 1 AS INT), 25)) AS kmer FROM uniq JOIN ctg c USING (contig_id) JOIN places p USING (rid) WHERE orientation = 0)
SELECT contig_id, rid, count(*) AS n_due, count(k.rid) AS n_there FROM due LEFT JOIN kmers k USING (kmer, rid, pos) GROUP BY contig_id, rid"""
)
def posting_lookup(spark, d):
    """For every read placed plus its k-mers as the contig has them, looked up in the index by (k-mer, read, position)."""
    index = v.sampled(spark, d)
    due = index.select("rid", "pos").join(v.unique(spark, d).where("orientation = 0").select("contig_id", "contig_pos", "rid"), "rid").join(v.contigs(spark, d), "contig_id")
    due = due.select("contig_id", "rid", "pos", F.upper(F.substring(F.col("seq"), (F.col("contig_pos") + F.col("pos") - 1).cast("int"), F.lit(25))).alias("kmer"))
    there = index.withColumn("there", F.lit(1))
    return due.join(there, ["kmer", "rid", "pos"], "left").groupBy("contig_id", "rid").agg(F.count(F.lit(1)).alias("n_due"), F.count("there").alias("n_there"))


@_query(f"WITH {v.RANKED}, x AS (SELECT c1, c2, max(n_best) AS n_pairs FROM ranked GROUP BY c1, c2) SELECT contig_id AS c1, c2, coalesce(n_pairs, 0) AS n_pairs FROM contigs LEFT JOIN x ON c1 = contig_id")
def pairs_between(spark, d):
    x = _ranked(spark, d).groupBy("c1", "c2").agg(F.max("n_best").alias("n_pairs"))
    return v.contigs(spark, d).select(F.col("contig_id").alias("c1")).join(x, "c1", "left").fillna(0, ["n_pairs"])


@_query("SELECT rid, max(contig_pos) AS contig_pos FROM match_info WHERE rid IS NOT NULL GROUP BY rid")
def last_placements(spark, d):
    """The later row of a read overwrites an earlier one; the rows have no other order than their position here."""
    return pairs.last_placement(v.table(spark, d, "match_info"), "contig_pos").select("rid", "contig_pos")


@_query(f"WITH {v.UNIQUE}, {v.CONTIGS} SELECT rid, contig_id, contig_pos FROM uniq JOIN ctg USING (contig_id) WHERE clen <= 400 OR contig_pos <= 200 OR contig_pos > clen - 200")
def end_placements(spark, d):
    return sinks.end_placements(v.unique(spark, d), v.contigs(spark, d), 200).select("rid", "contig_id", "contig_pos")


def _across(spark, d):
    """Reads that lie across the middle of their contig, with what they say beyond it."""
    size = v.contigs(spark, d).select("contig_id", F.floor(F.length("seq") / 2).cast("int").alias("half"))
    x = _placed_seqs(spark, d).join(size, "contig_id").where("contig_pos <= half and contig_pos + seqlen - 1 > half")
    return x.withColumn("tail", F.expr("substring(oseq, half - contig_pos + 2, seqlen)"))


@_query(f"WITH {v.PATHS} SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY support DESC, seq) AS INT) AS path_no, CAST(count(*) OVER (PARTITION BY key) AS INT) AS n_paths, seq, support, CAST(n_incorrect AS INT) AS n_incorrect, first_base, n_max, n_second, total, NOT (n_incorrect > 3 OR (n_second / n_max > 0.7 AND n_incorrect > 1 AND total > 10) OR (n_max / total < 0.6 AND n_incorrect > 2)) AS decision FROM ways JOIN heads USING (key) JOIN wrong USING (key)")
def candidate_paths(spark, d):
    return paths.candidate_paths(_across(spark, d).select(F.col("contig_id").alias("key"), "tail"))


@_query(f"WITH {v.PATHS}, r AS (SELECT key, seq, support, CAST(row_number() OVER (PARTITION BY key ORDER BY support DESC, seq) AS INT) AS rank FROM ways) SELECT * FROM r WHERE rank <= 20")
def ordered_support(spark, d):
    """The best 20 paths of each contig by support."""
    x = paths.candidate_paths(_across(spark, d).select(F.col("contig_id").alias("key"), "tail"))
    return x.where("path_no <= 20").select("key", "seq", "support", F.col("path_no").alias("rank"))


@_query()
def settled_reads(spark, d):
    """Every read that starts before the middle of its contig, as far as it has run there: matches and mismatches against the contig."""
    c = v.contigs(spark, d).select("contig_id", F.upper("seq").alias("text"), F.floor(F.length("seq") / 2).cast("int").alias("half"))
    x = _placed_seqs(spark, d).join(c, "contig_id").where("contig_pos <= half and length(oseq) > 0").withColumn("base_pos", F.least(F.expr("half - contig_pos + 1"), F.length("oseq")))
    wrong = bases.hamming(F.expr("left(oseq, base_pos)"), F.expr("substring(text, contig_pos, base_pos)")).cast("int")
    x = x.withColumn("mismatches", wrong).withColumn("matched", F.col("base_pos") - F.col("mismatches"))
    x = x.select("contig_id", "rid", "orientation", F.length("oseq").alias("seqlen"), "base_pos", "matched", "mismatches", F.lit(1.0).alias("ratio"), F.col("half").alias("contig_len"))
    x = x.withColumn("mated", F.lit(True)).withColumn("locked", F.lit(False)).withColumn("run", F.when(F.col("mismatches") == 0, F.col("base_pos")).otherwise(0))
    return active.lock(active.unmate_failed(active.settle(x)), 2, 2.0).select("contig_id", "rid", "seqlen", "base_pos", "matched", "mismatches", "status", "mated", "locked")


@_query()
def stop_rules(spark, d):
    """The guard rules at every position of the pile-up: mate votes and all votes, read ends, bare tail, density, candidate paths."""
    h = paths.candidate_paths(_across(spark, d).select(F.col("contig_id").alias("key"), "tail")).where("path_no = 1")
    h = h.select(F.col("key").alias("contig_id"), "n_paths", F.col("n_max").alias("path_max"), F.col("n_second").alias("path_second"), (F.col("n_max") / F.col("total")).alias("path_share"))
    x = _state(spark, d).join(h, "contig_id", "left").fillna({"n_paths": 1, "path_max": 1, "path_second": 0, "path_share": 1.0})
    x = active.window_counts(x, 100).withColumns({"length": F.col("pos"), "path_agrees": F.col("path_max") > F.col("path_second"), "single_pe": F.col("pe_max") == 1})
    return active.with_state(x).select("contig_id", "pos", active.stop_rule(100, 4.0, 240, 300).alias("rule"))


@_query()
def pilot_insert(spark, d):
    return assemble.pilot_insert(v.valid(spark, d))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
