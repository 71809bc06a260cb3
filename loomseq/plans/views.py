"""Tables of a data directory in the forms the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmers, pairs, quality


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def reads(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return quality.first_delivery(table(spark, d, "read_buf"), columns or ("seq", "qual"))


def valid(spark: SparkSession, d: str) -> DataFrame:
    return quality.valid_reads(reads(spark, d))


def sampled(spark: SparkSession, d: str) -> DataFrame:
    return kmers.explode_kmers(valid(spark, d))


def contigs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contigs").where("contig_id is not null and contigseq is not null").select("contig_id", F.col("contigseq").alias("seq"))


def unique(spark: SparkSession, d: str) -> DataFrame:
    return pairs.unique_placements(table(spark, d, "match_info"))


def half_placements(spark: SparkSession, d: str) -> DataFrame:
    """Placements on contigs cut in two, so that mates on one contig link two pieces; a read belongs to the piece it starts in.

    The table's own placements hold no pair whose mates lie at the ends of two contigs, so links would be empty without it."""
    size = contigs(spark, d).select("contig_id", F.floor(F.length("seq") / 2).cast("int").alias("half"))
    x = unique(spark, d).join(size, "contig_id")
    right = F.col("contig_pos") > F.col("half")
    pos = F.when(right, F.col("contig_pos") - F.col("half")).otherwise(F.col("contig_pos"))
    return x.select((2 * F.col("contig_id") + right.cast("int")).alias("contig_id"), pos.alias("contig_pos"), "matchlen", "rid", "seqlen", "orientation", F.when(right, 0).otherwise(1).alias("contig_end"))


def half_contigs(spark: SparkSession, d: str) -> DataFrame:
    half = F.floor(F.length("seq") / 2).cast("int")
    pieces = F.array(F.struct((2 * F.col("contig_id")).alias("contig_id"), F.substring("seq", F.lit(1), half).alias("seq")), F.struct((2 * F.col("contig_id") + 1).alias("contig_id"), F.substring(F.col("seq"), half + 1, F.length("seq")).alias("seq")))
    return contigs(spark, d).select(F.explode(pieces).alias("p")).select("p.*")


#: The same in SQL.
READS = "reads AS (SELECT rid, arg_min(pair_id, arrival_no) AS pair_id, arg_min(run_id, arrival_no) AS run_id, arg_min(seq, arrival_no) AS seq, arg_min(qual, arrival_no) AS qual FROM read_buf WHERE rid IS NOT NULL AND seq IS NOT NULL GROUP BY rid)"
_PHRED = "list_avg([ord(c) - 33 FOR c IN string_split({0}, '')])"
FLAGGED = f"""{READS},
tails AS (SELECT *, CAST(ceil(length(qual) * 0.2) AS INT) AS t FROM reads),
flagged AS (SELECT * EXCLUDE (t), coalesce(length(seq) > 0 AND length(translate(seq, 'Nn.', '')) = length(seq) AND (length(seq) - length(replace(seq, 'A', ''))) / length(seq) < 0.9
 AND (qual IS NULL OR (length(translate(qual, '!"', '')) = length(qual)
  AND (length(qual) = 0 OR {_PHRED.format("substr(qual, length(qual) - t + 1, t)")} >= 3)
  AND (length(qual) - t <= 0 OR {_PHRED.format("substr(qual, 1, length(qual) - t)")} >= 10))), false) AS valid FROM tails)"""
VALID = f"{FLAGGED}, good AS (SELECT rid, pair_id, upper(seq) AS seq FROM flagged WHERE valid)"
KMERS = f"""{VALID},
sizes AS (SELECT rid, seq, length(seq) - 24 AS n, CAST(ceil(length(seq) * 3 / 100.0) AS INT) AS h, CAST(ceil(length(seq) * 8 / 100.0) AS INT) AS t FROM good),
places AS (SELECT rid, seq, unnest(list_distinct(CASE WHEN n < 1 THEN [] WHEN h + t >= n THEN list_concat(range(1, n + 1, 2), [CAST(n AS BIGINT)]) ELSE list_concat(range(1, h + 1, 2), range(greatest(n - t + 1, 1), n + 1, 2)) END)) AS pos FROM sizes),
kmers AS (SELECT substr(seq, pos, 25) AS kmer, rid, CAST(pos AS INT) AS pos FROM places)"""
CONTIGS = "ctg AS (SELECT contig_id, contigseq AS seq, length(contigseq) AS clen FROM contigs WHERE contigseq IS NOT NULL)"
PLACED = "placed AS (SELECT DISTINCT contig_id, contig_pos, matchlen, rid, seqlen, orientation, contig_end FROM match_info WHERE contig_id > 0 AND rid IS NOT NULL)"
UNIQUE = f"{PLACED}, uniq AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY rid) AS n FROM placed) WHERE n = 1)"
_PAIR = "(SELECT *, (rid + 1) // 2 AS pair_id FROM {0} WHERE rid % 2 = {1})"
_MATES = f"mates AS (SELECT a.pair_id, a.rid AS rid_1, b.rid AS rid_2, a.contig_id AS contig_id_1, b.contig_id AS contig_id_2, a.contig_pos AS contig_pos_1, b.contig_pos AS contig_pos_2, a.matchlen AS matchlen_1, b.matchlen AS matchlen_2, a.seqlen AS seqlen_1, b.seqlen AS seqlen_2, a.orientation AS orientation_1, b.orientation AS orientation_2, a.contig_end AS contig_end_1, b.contig_end AS contig_end_2 FROM {_PAIR.format('uniq', 1)} a JOIN {_PAIR.format('uniq', 0)} b USING (pair_id))"
MATES = f"{UNIQUE}, {_MATES}"
FRAGS = f"""{MATES}, frags AS (SELECT * FROM (SELECT pair_id, contig_id_1 AS contig_id, CASE WHEN orientation_1 = 0 THEN contig_pos_2 + matchlen_2 - contig_pos_1 ELSE contig_pos_1 + matchlen_1 - contig_pos_2 END AS frag,
 CASE WHEN orientation_1 = 0 THEN contig_pos_1 <= contig_pos_2 ELSE contig_pos_2 <= contig_pos_1 END AS ok
 FROM mates WHERE contig_id_1 = contig_id_2 AND matchlen_1 = seqlen_1 AND matchlen_2 = seqlen_2 AND orientation_1 <> orientation_2) WHERE ok)"""
_SIDE = "SELECT pair_id, contig_id_{0} AS c1, contig_end_{0} AS e1, contig_pos_{0} AS pos1, orientation_{0} AS o1, seqlen_{0} AS len1, contig_id_{1} AS c2, contig_end_{1} AS e2, contig_pos_{1} AS pos2, orientation_{1} AS o2, seqlen_{1} AS len2 FROM mates WHERE contig_id_1 <> contig_id_2 AND contig_end_1 >= 0 AND contig_end_2 >= 0"
#: Contigs cut in two, so that mates on one contig link two pieces: piece 2c (its 3' end) and 2c + 1 (its 5' end).
HALVES = f"""{PLACED}, {CONTIGS.replace("ctg AS", "whole AS")},
once AS (SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY rid) AS n FROM placed) WHERE n = 1),
uniq AS (SELECT CASE WHEN contig_pos > clen // 2 THEN 2 * contig_id + 1 ELSE 2 * contig_id END AS contig_id, CASE WHEN contig_pos > clen // 2 THEN contig_pos - clen // 2 ELSE contig_pos END AS contig_pos,
 matchlen, rid, seqlen, orientation, CASE WHEN contig_pos > clen // 2 THEN 0 ELSE 1 END AS contig_end FROM once JOIN whole USING (contig_id)),
ctg AS (SELECT 2 * contig_id AS contig_id, substr(seq, 1, clen // 2) AS seq, clen // 2 AS clen FROM whole UNION ALL SELECT 2 * contig_id + 1, substr(seq, CAST(clen // 2 + 1 AS INT)), clen - clen // 2 FROM whole)"""
LINKS = f"""{HALVES}, {_MATES}, sides AS ({_SIDE.format(1, 2)} UNION ALL {_SIDE.format(2, 1)}),
near AS (SELECT *, e1 IN (0, 2) AND o1 = 1 AS five1, e1 IN (1, 2) AND o1 = 0 AS three1, e2 IN (0, 2) AND o2 = 1 AS five2, e2 IN (1, 2) AND o2 = 0 AS three2 FROM sides),
links AS (SELECT *, CASE WHEN three1 AND five2 THEN 0 WHEN three1 AND three2 THEN 1 WHEN five1 AND three2 THEN 2 WHEN five1 AND five2 THEN 3 END AS s FROM near)"""
EDGES = "SELECT DISTINCT c1, e1, c2, e2, coalesce(n[1], 0) AS n0, coalesce(n[2], 0) AS n1, coalesce(n[3], 0) AS n2, coalesce(n[4], 0) AS n3, gap FROM contig_edges WHERE n IS NOT NULL"
RANKED = f"""edges AS (SELECT * FROM ({EDGES}) WHERE n0 + n1 + n2 + n3 > 0),
lists AS (SELECT *, list_sort([(-n0, 0), (-n1, 1), (-n2, 2), (-n3, 3)]) AS r FROM edges),
ranked AS (SELECT * EXCLUDE (r), r[1][2] AS best, -r[1][1] AS n_best, r[2][2] AS second, -r[2][1] AS n_second FROM lists)"""
PILE = f"""{READS}, {UNIQUE},
oriented AS (SELECT u.*, CASE WHEN orientation = 1 THEN reverse(translate(upper(seq), 'ACGT', 'TGCA')) ELSE upper(seq) END AS oseq FROM uniq u JOIN reads USING (rid)),
bases AS (SELECT contig_id, contig_pos + i AS pos, substr(oseq, CAST(i + 1 AS INT), 1) AS base, rid FROM (SELECT *, unnest(range(length(oseq))) AS i FROM oriented)),
votes AS (SELECT contig_id, pos, count(*) FILTER (base = 'A') AS n_A, count(*) FILTER (base = 'C') AS n_C, count(*) FILTER (base = 'G') AS n_G, count(*) FILTER (base = 'T') AS n_T FROM bases GROUP BY contig_id, pos),
vlists AS (SELECT *, list_sort([(-n_A, 'A'), (-n_C, 'C'), (-n_G, 'G'), (-n_T, 'T')]) AS r, n_A + n_C + n_G + n_T AS total FROM votes),
winners AS (SELECT contig_id, pos, r[1][2] AS base, -r[1][1] AS n_max, r[2][2] AS second, -r[2][1] AS n_second, total FROM vlists)"""
MATED = "mated AS (SELECT a.rid FROM uniq a JOIN uniq b ON b.rid = a.rid + CASE WHEN a.rid % 2 = 1 THEN 1 ELSE -1 END AND a.contig_id = b.contig_id)"
#: Votes of all reads (se) and of those with a mate on the contig (pe), and what lies behind each position: bare tail, density of read ends.
STATE = f"""{PILE}, {CONTIGS}, {MATED},
pvotes AS (SELECT contig_id, pos, list_sort([(-count(*) FILTER (base = 'A'), 'A'), (-count(*) FILTER (base = 'C'), 'C'), (-count(*) FILTER (base = 'G'), 'G'), (-count(*) FILTER (base = 'T'), 'T')]) AS r FROM bases WHERE rid IN (SELECT rid FROM mated) GROUP BY contig_id, pos),
fin AS (SELECT contig_id, contig_pos + seqlen - 1 AS pos, count(*) AS n FROM uniq GROUP BY ALL),
tot AS (SELECT contig_id, sum(n) AS total FROM fin GROUP BY contig_id),
both_ AS (SELECT w.contig_id, w.pos, w.n_max AS se_max, w.n_second AS se_sec, coalesce(-p.r[1][1], 0) AS pe_max, coalesce(-p.r[2][1], 0) AS pe_sec, coalesce(n, 0) AS n_ends
 FROM winners w LEFT JOIN pvotes p ON p.contig_id = w.contig_id AND p.pos = w.pos LEFT JOIN fin f ON f.contig_id = w.contig_id AND f.pos = w.pos),
state AS (SELECT s.contig_id, pos, se_max, se_sec, pe_max, pe_sec, CAST(pos - coalesce(max(CASE WHEN n_ends > 0 THEN pos END) OVER (PARTITION BY s.contig_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS tail,
 sum(n_ends) OVER (PARTITION BY s.contig_id ORDER BY pos RANGE BETWEEN 99 PRECEDING AND CURRENT ROW) * clen / (total * least(100, clen)) AS ratio FROM both_ s JOIN ctg USING (contig_id) JOIN tot USING (contig_id))"""
#: Reads across the middle of their contig, what they say beyond it, and the paths that come of it.
ACROSS = f"""{PILE}, {CONTIGS},
across AS (SELECT rid, contig_id, substr(oseq, CAST(clen // 2 - contig_pos + 2 AS INT)) AS tail FROM oriented JOIN ctg USING (contig_id) WHERE contig_pos <= clen // 2 AND contig_pos + seqlen - 1 > clen // 2)"""
PATHS = f"""{ACROSS},
tails AS (SELECT contig_id, tail, count(*) AS n FROM across WHERE tail <> '' GROUP BY ALL),
letters AS (SELECT contig_id, tail, n, i, substr(tail, CAST(i AS INT), 1) AS b FROM (SELECT *, unnest(range(1, length(tail) + 1)) AS i FROM tails)),
seen AS (SELECT contig_id, i, b, sum(n) AS v FROM letters GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY contig_id, i ORDER BY v DESC, b) AS r, sum(v) OVER (PARTITION BY contig_id, i) AS total FROM seen),
swap AS (SELECT s.contig_id, s.i, s.b, f.b AS top FROM ranks s JOIN ranks f ON f.contig_id = s.contig_id AND f.i = s.i AND f.r = 1 WHERE s.r = 2 AND s.v = 1 AND s.total >= 10),
fixed AS (SELECT contig_id, tail, n, string_agg(coalesce(top, b), '' ORDER BY i) AS t FROM letters LEFT JOIN swap USING (contig_id, i, b) GROUP BY ALL),
texts AS (SELECT contig_id, t, max(n) AS n, sum(n) AS s FROM fixed GROUP BY ALL),
reps AS (SELECT * FROM texts a WHERE NOT EXISTS (SELECT 1 FROM texts b WHERE a.contig_id = b.contig_id AND length(b.t) > length(a.t) AND starts_with(b.t, a.t))),
home AS (SELECT x.contig_id, x.s, r.t, row_number() OVER (PARTITION BY x.contig_id, x.t ORDER BY length(r.t) DESC, r.n DESC, r.t) AS no FROM texts x JOIN reps r ON r.contig_id = x.contig_id AND starts_with(r.t, x.t)),
ways AS (SELECT contig_id AS key, t AS seq, CAST(sum(s) AS BIGINT) AS support FROM home WHERE no = 1 GROUP BY ALL),
wcols AS (SELECT key, i, b, sum(support) AS v FROM (SELECT key, support, i, substr(seq, CAST(i AS INT), 1) AS b FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM ways)) GROUP BY ALL),
wtop AS (SELECT key, i, list_sort(list((-v, b))) AS r, sum(v) AS total FROM wcols GROUP BY ALL),
wrong AS (SELECT key, count(*) FILTER ((total >= 10 AND -r[1][1] / total < 0.9) OR (total < 10 AND len(r) > 1 AND r[1][1] / r[2][1] < 4)) AS n_incorrect FROM wtop GROUP BY key),
heads AS (SELECT key, r[1][2] AS first_base, CAST(-r[1][1] AS BIGINT) AS n_max, CAST(coalesce(-r[2][1], 0) AS BIGINT) AS n_second, CAST(total AS BIGINT) AS total FROM wtop WHERE i = 1)"""
