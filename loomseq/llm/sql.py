"""The same results in plain SQL, where it can express them on whole tables."""

from __future__ import annotations

import sys
import unicodedata

_RECS = "recs AS (SELECT rid, arg_min(seq, arrival_no) AS seq, arg_min(hashcode, arrival_no) AS hashcode FROM read_buf WHERE seq IS NOT NULL GROUP BY rid)"
_GRAMS = "grams AS (SELECT rid, n, substr(upper(seq), CAST(p AS INT), CAST(n AS INT)) AS term FROM (SELECT rid, seq, n, unnest(range(1, length(seq) - n + 2)) AS p FROM recs, (SELECT unnest(range({lo}, 9)) AS n)))"
_COUNTS = """total AS (SELECT count(*) AS total FROM recs),
counts AS (SELECT 'seq' AS field, term, n, count(*) AS n_occ, count(DISTINCT rid) AS n_records FROM grams WHERE regexp_full_match(term, '[ACGT]+') GROUP BY term, n
 UNION ALL SELECT 'hashcode', CAST(hashcode AS VARCHAR), 0, count(*), count(*) FROM recs WHERE hashcode IS NOT NULL GROUP BY hashcode),
marked AS (SELECT field, term, n, n_occ, n_records, CASE WHEN n_records * 100 > total THEN 'common' WHEN n_records = 1 OR n_records * 5000 < total THEN 'rare' END AS mark FROM counts, total)"""

_READS = "SELECT 'read' AS rec_kind, 40 AS m, min(rid) AS id, upper(seq) AS seq FROM read_buf WHERE seq IS NOT NULL GROUP BY upper(seq)"
_CONTIGS = "SELECT 'contig' AS rec_kind, 100 AS m, CAST(contig_id AS BIGINT) AS id, upper(contigseq) AS seq FROM contigs WHERE contigseq IS NOT NULL"

_SPANS = """win AS (SELECT rec_kind, m, id, p, substr(seq, CAST(p AS INT), m) AS w FROM (SELECT *, unnest(range(1, length(seq) - m + 2)) AS p FROM recs)),
good AS (SELECT * FROM win WHERE regexp_full_match(w, '[ACGT]+')),
shared AS (SELECT rec_kind, w FROM good GROUP BY rec_kind, w HAVING min(id) <> max(id)),
hit AS (SELECT rec_kind, id, p, p + m - 1 AS e FROM good SEMI JOIN shared USING (rec_kind, w)),
island AS (SELECT *, sum(CASE WHEN p <= prev + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY rec_kind, id ORDER BY p) AS i
 FROM (SELECT *, max(e) OVER (PARTITION BY rec_kind, id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hit)),
spans AS (SELECT rec_kind, id AS rec_id, min(p) AS from_pos, max(e) AS to_pos FROM island GROUP BY rec_kind, id, i)"""

#: Components of the table links(rec_kind, a, b): each node takes the least class of its neighbours until nothing changes.
_CLASSES = """sym AS MATERIALIZED (SELECT rec_kind, a, b FROM links UNION SELECT rec_kind, b, a FROM links),
cc(rec_kind, id, class_id) USING KEY (rec_kind, id) AS (SELECT DISTINCT rec_kind, a, a FROM sym
 UNION SELECT s.rec_kind, s.a, min(c.class_id) FROM sym s JOIN cc c ON c.rec_kind = s.rec_kind AND c.id = s.b JOIN recurring.cc r ON r.rec_kind = s.rec_kind AND r.id = s.a
 GROUP BY s.rec_kind, s.a, r.class_id HAVING min(c.class_id) < r.class_id)"""

_STEP = "CAST((CAST(xor(x, x >> {s}) AS UHUGEINT) * {c}) % 18446744073709551616 AS UBIGINT)"

_PAIRS = """SELECT rec_kind, id_a, id_b FROM (
 SELECT a.rec_kind, a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS o
 FROM words a JOIN words b ON a.rec_kind = b.rec_kind AND a.w = b.w AND a.id < b.id GROUP BY ALL)
 WHERE o * 5 >= (na + nb - o) * 3"""




_NEAR = f"""recs AS ({_READS} UNION ALL {_CONTIGS}),
 raw AS (SELECT DISTINCT rec_kind, id, substr(seq, CAST(p AS INT), 12) AS w FROM (SELECT *, unnest(range(1, length(seq) - 10)) AS p FROM recs)),
 canon AS (SELECT DISTINCT rec_kind, id, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS w FROM raw WHERE regexp_full_match(w, '[ACGT]+')),
 words AS (SELECT *, count(*) OVER (PARTITION BY rec_kind, id) AS n FROM canon)"""


def _characters() -> list[tuple[str, str]]:
    """Characters and what they are written as, by the rules of Unicode: blanks of Zs, full-width forms, format characters, and
    each of several characters (a letter and its marks) as these."""
    out = []
    for cp in range(128, sys.maxunicode + 1):
        ch = chr(cp)
        kind, dec = unicodedata.category(ch), unicodedata.decomposition(ch)
        if kind == "Cf":
            out.append((ch, ""))
        elif kind == "Zs":
            out.append((ch, " "))
        elif dec.startswith("<wide>"):
            out.append((ch, "".join(chr(int(x, 16)) for x in dec.split()[1:])))
        elif dec and not dec.startswith("<") and not 0xF900 <= cp <= 0xFAFF and cp < 0x2F800:  # no ideographs
            out.append((ch, unicodedata.normalize("NFD", ch)))
    return out


def _looks() -> str:
    """documents with their form: every character is written out, then each glyph as its plain letters, then all is composed."""
    chars = ", ".join("(" + str(ord(a)) + ", '" + b.replace("'", "''") + "')" for a, b in _characters())
    return f"""letters AS (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents WHERE text IS NOT NULL),
written AS (SELECT c, coalesce(w, c) AS w FROM letters LEFT JOIN (VALUES {chars}) v(cp, w) ON unicode(c) = cp),
plains AS (SELECT c, unnest(string_split(w, '')) AS x, generate_subscripts(string_split(w, ''), 1) AS i FROM written WHERE w <> ''),
spelt AS (SELECT c, string_agg(coalesce(plain, x), '' ORDER BY i) AS s FROM plains LEFT JOIN (SELECT glyph, any_value(plain) AS plain FROM look_alikes GROUP BY glyph) g ON x = glyph GROUP BY c),
places AS (SELECT doc_id, text, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
forms AS (SELECT doc_id, text, nfc_normalize(coalesce(string_agg(s, '' ORDER BY i), '')) AS form FROM places LEFT JOIN spelt USING (c) GROUP BY doc_id, text)"""


def oracle_sql() -> dict[str, str]:
    looks = _looks()
    return {
        "p9_found": f"WITH {looks} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM forms a JOIN forms b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text",
        "p9_classes": f"WITH {looks} SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_id FROM forms",
        "p1_found": f"WITH {_RECS}, {_GRAMS.format(lo=8)}, {_COUNTS} SELECT field, term, mark FROM marked WHERE (field = 'seq' AND mark IS NOT NULL) OR (field = 'hashcode' AND mark = 'common')",
        "p1_terms": f"WITH {_RECS}, {_GRAMS.format(lo=1)}, {_COUNTS} SELECT field, term, CAST(n AS INT) AS n, n_occ, n_records, mark FROM marked",
        "p1_words": r"""WITH docs AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\x0b]+'), lambda w: w <> '') AS ws FROM documents WHERE text IS NOT NULL),
 total AS (SELECT count(*) AS total FROM docs),
 grams AS (SELECT doc_id, n, array_to_string(ws[p:p + n - 1], ' ') AS term FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM docs, (SELECT unnest([1, 2, 3]) AS n))),
 counts AS (SELECT term, CAST(n AS INT) AS n, count(*) AS n_occ, count(DISTINCT doc_id) AS n_records FROM grams GROUP BY term, n)
 SELECT term, n, n_occ, n_records, CASE WHEN n_records * 100 > total THEN 'common' WHEN n_records = 1 OR n_records * 5000 < total THEN 'rare' END AS mark FROM counts, total""",
        "p2_found": f"WITH recs AS ({_READS} UNION ALL {_CONTIGS}), {_SPANS} SELECT rec_kind, rec_id, from_pos, to_pos FROM spans",
        "p2_portion": f"""WITH recs AS ({_READS} UNION ALL {_CONTIGS}), {_SPANS},
 per AS (SELECT rec_kind, rec_id, CAST(sum(to_pos - from_pos + 1) AS BIGINT) AS n_shared, count(*) AS n_spans FROM spans GROUP BY rec_kind, rec_id)
 SELECT r.rec_kind, id AS rec_id, length(seq) AS n_letters, coalesce(n_shared, 0) AS n_shared, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN length(seq) > 0 THEN round(coalesce(n_shared, 0) / length(seq), 6) ELSE 0.0 END AS share
  FROM (SELECT DISTINCT rec_kind, id, seq FROM recs) r LEFT JOIN per ON r.rec_kind = per.rec_kind AND id = rec_id""",
        "p2_classes": f"""WITH RECURSIVE recs AS ({_READS} UNION ALL {_CONTIGS}), {_SPANS.split("," + chr(10) + "shared AS")[0]},
links AS MATERIALIZED (SELECT DISTINCT rec_kind, a, b FROM (SELECT rec_kind, id AS a, min(id) OVER (PARTITION BY rec_kind, w) AS b FROM good) WHERE a <> b), {_CLASSES}
SELECT rec_kind, id AS rec_id, class_id FROM cc""",
        "p4_found": "SELECT hashcode FROM read_buf WHERE hashcode IS NOT NULL GROUP BY hashcode HAVING count(*) * 200 >= (SELECT count(*) FROM read_buf)",
        "p4_counts": "SELECT hashcode, count(*) AS n_rows FROM read_buf WHERE hashcode IS NOT NULL GROUP BY hashcode HAVING count(*) * 500 >= (SELECT count(*) FROM read_buf)",
        "p5_found": f"WITH {_NEAR} {_PAIRS}",
        "p5_classes": f"""WITH RECURSIVE {_NEAR}, links AS MATERIALIZED (SELECT rec_kind, id_a AS a, id_b AS b FROM ({_PAIRS})), {_CLASSES},
 n AS (SELECT rec_kind, a AS id, count(*) AS n_links FROM sym GROUP BY ALL),
 members AS (SELECT DISTINCT 'read' AS rec_kind, rid AS rec_id, min(rid) OVER (PARTITION BY upper(seq)) AS id FROM read_buf WHERE seq IS NOT NULL AND rid IS NOT NULL
  UNION ALL SELECT 'contig', CAST(contig_id AS BIGINT), CAST(contig_id AS BIGINT) FROM contigs WHERE contigseq IS NOT NULL)
 SELECT rec_kind, rec_id, coalesce(class_id, id) AS class_id, coalesce(n_links, 0) AS n_links FROM members LEFT JOIN cc USING (rec_kind, id) LEFT JOIN n USING (rec_kind, id)""",
        "p6_rate": f"""WITH k AS (SELECT CAST(-1 AS BIGINT) AS no, hashcode FROM known_seqs WHERE hashcode IS NOT NULL UNION ALL SELECT arrival_no, hashcode FROM read_buf WHERE hashcode IS NOT NULL AND arrival_no IS NOT NULL),
 one AS (SELECT no, hashcode, {_STEP.format(s=30, c=0xBF58476D1CE4E5B9)} AS x FROM (SELECT *, CAST((CAST(hashcode AS HUGEINT) + 18446744073709551616) % 18446744073709551616 AS UBIGINT) AS x FROM k)),
 two AS (SELECT no, hashcode, {_STEP.format(s=27, c=0x94D049BB133111EB)} AS x FROM one),
 words AS (SELECT no, hashcode, xor(x, x >> 31) >> 32 AS word FROM two),
 seen AS (SELECT no, no > min(no) OVER (PARTITION BY hashcode) AS truly, no > min(no) OVER (PARTITION BY word) AS got FROM words)
 SELECT count(*) AS n_rows, CAST(count(*) FILTER (truly) AS BIGINT) AS n_seen, CAST(count(*) FILTER (truly <> got) AS BIGINT) AS n_wrong, count(*) FILTER (truly <> got) / count(*) AS wrong_rate, 32 AS bits FROM seen WHERE no >= 0""",
        "p7_limits": """WITH s AS (SELECT strlen(text) + 1 AS n FROM documents WHERE text IS NOT NULL)
 SELECT count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum((n + 2047) // 2048) AS BIGINT) AS n_pieces, CAST(0 AS BIGINT) AS n_early_cuts, CAST(0 AS BIGINT) AS n_overfull, true AS tight FROM s""",
        "p8_limits": """WITH s AS (SELECT source, sum(strlen(text) + 1) AS size, count(*) AS n FROM documents WHERE text IS NOT NULL AND source IN (SELECT source FROM mix_targets) GROUP BY source),
 t AS (SELECT t.source, coalesce(n, 0) AS n_docs, CAST(coalesce(size, 0) AS BIGINT) AS n_tokens, weight * (SELECT sum(size) FROM s) AS goal, CAST(coalesce(size, 0) * max_repeats AS BIGINT) AS limit_tokens FROM mix_targets t LEFT JOIN s USING (source))
 SELECT source, n_docs, n_tokens, round(goal, 3) AS target_tokens, limit_tokens, limit_tokens < goal AS short, false AS too_often, CAST(0 AS BIGINT) AS left_over, true AS near FROM t""",
        "p6_found": "SELECT arrival_no FROM (SELECT arrival_no, hashcode, min(arrival_no) OVER (PARTITION BY hashcode) AS first FROM read_buf WHERE hashcode IS NOT NULL) WHERE arrival_no > first OR hashcode IN (SELECT hashcode FROM known_seqs WHERE hashcode IS NOT NULL)",
        "p7_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) + 1 > 2048",
        "p8_found": """WITH s AS (SELECT source, sum(strlen(text) + 1) AS size FROM documents WHERE text IS NOT NULL AND source IN (SELECT source FROM mix_targets) GROUP BY source)
 SELECT t.source FROM mix_targets t LEFT JOIN s USING (source) WHERE coalesce(size, 0) * max_repeats < weight * (SELECT sum(size) FROM s)""",
    }
