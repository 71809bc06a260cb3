"""Visually identical text in one form: transitive look-alike classes and a multi-pattern rewrite.

Strings and code points that look the same are joined by union-find: glyphs with their plain letters, full-width forms
with ordinary characters, blanks with the space, invisible format characters with nothing. The classes are transitive.
Each class gets a representative: nothing or the space in their classes; a string of several letters where the class has
one (writing a ligature out never clashes with its neighbours, drawing letters together may); else the character most
frequent in the collection. Texts are decomposed, rewritten greedily (leftmost, longest) by an Aho-Corasick automaton
and composed again, so a letter with its mark is the same as one character or two. Only texts that hold a character that
a rewrite could change go through it; an Arrow pattern of these characters finds them.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flat import flat_bytes, slices
from ..functions.scratch import written

_MOST_GLYPHS = 1 << 17
_BLOCK = 4 << 20


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def root(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        self.up[self.root(a)] = self.root(b)

    def members(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.root(x), []).append(x)
        return list(out.values())


def _code_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(sys.maxunicode + 1, np.int64)
    for b in slices(batches, "text", _BLOCK):
        raw, _ = flat_bytes(b.column("text"))
        total[:128] += np.bincount(raw, minlength=256)[:128]
        wide = np.flatnonzero(raw >= 128)  # bytes of characters beyond ASCII: decoded alone, they stay in order
        if wide.size:
            seen = np.bincount(np.frombuffer(raw[wide].tobytes().decode().encode("utf-32-le"), np.uint32))
            total[: seen.size] += seen
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cp", "n"])


def _decomposed(s: str) -> str:
    return unicodedata.normalize("NFD", s)


def build(pairs: list[tuple[str, str]], counts: dict[int, int]) -> dict[str, str]:
    """Rewrites (decomposed) member -> representative for the code points counted and the glyphs given."""
    whole, counts = counts, {}
    for cp, n in whole.items():
        for ch in _decomposed(chr(cp)):
            counts[ord(ch)] = counts.get(ord(ch), 0) + n
    c = Classes()
    seen = {chr(p) for p in counts} | {ch for g, p in pairs for ch in _decomposed(g) + _decomposed(p)}
    for ch in seen:
        kind, dec = unicodedata.category(ch), unicodedata.decomposition(ch)
        if kind == "Cf":
            c.join(ch, "")
        elif kind == "Zs":
            c.join(ch, " ")
        elif dec.startswith("<wide>"):
            c.join(ch, _decomposed("".join(chr(int(x, 16)) for x in dec.split()[1:])))
    for glyph, plain in pairs:
        if glyph != plain:
            c.join(_decomposed(glyph), _decomposed(plain))

    def rank(x: str) -> tuple:
        if len(x) == 1:
            return (1, -counts.get(ord(x), 0), x)
        return (0, -len(x), x)

    chosen: dict[str, str] = {}
    for group in c.members():
        best = "" if "" in group else " " if " " in group else min(group, key=rank)
        chosen.update({x: best for x in group})

    def spell(s: str, above: frozenset[str] = frozenset()) -> str:
        if s in above:
            raise ValueError(f"look-alike classes spell each other in a circle: {sorted(above)}")
        return "".join(spell(chosen[x], above | {s}) if x in chosen and chosen[x] != x else x for x in s)

    final = {x: spell(best) if len(best) > 1 else best for x, best in chosen.items()}
    return {x: r for x, r in final.items() if x and x != r}


def touched(rules: dict[str, str], seen: Iterable[int]) -> str | None:
    """A pattern of those of the characters `seen` without which a text is its own form; None if there are none of them.

    They are the characters whose decomposition starts a rule, marks and others that move or join when a text is decomposed
    and composed, and characters that don't come back from that alone."""
    first = {x[0] for x in rules}

    def moves(cp: int) -> bool:
        ch = chr(cp)
        dec = unicodedata.normalize("NFD", ch)
        return unicodedata.combining(ch) > 0 or unicodedata.category(ch)[0] == "M" or 0x1100 <= cp <= 0x11FF or any(x in first for x in dec) or unicodedata.normalize("NFC", dec) != ch

    got = [cp for cp in sorted(seen) if moves(cp)]
    return "[" + "".join(f"\\x{{{cp:x}}}" for cp in got) + "]" if got else None


def _rewrite(rules: dict[str, str], pattern: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        gone = {ord(x): None for x, r in rules.items() if len(x) == 1 and r == ""}
        automaton = ahocorasick.Automaton()
        for x, r in rules.items():
            if r or len(x) > 1:
                automaton.add_word(x, (len(x), r))
        any_rule = len(automaton) > 0
        automaton.make_automaton()

        def one(t: str) -> str:
            t = unicodedata.normalize("NFD", t.translate(gone))
            if any_rule:
                out, at = [], 0
                for end, (n, r) in automaton.iter_long(t):
                    out += [t[at : end + 1 - n], r]
                    at = end + 1
                t = "".join([*out, t[at:]]) if out else t
            return unicodedata.normalize("NFC", t)

        for b in batches:
            form = b.column("text")
            if pattern is not None:
                hit = pc.fill_null(pc.match_substring_regex(form, pattern), False)
                if pc.any(hit).as_py():
                    form = pc.replace_with_mask(form, hit, pa.array([one(t) for t in form.filter(hit).to_pylist()], form.type))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text"), form], ["id", "text", "form"])

    return run


def rules_for(docs: DataFrame, look_alikes: DataFrame, text: str = "text") -> tuple[dict[str, str], str | None]:
    """Rewrites for a collection, and the pattern of characters that are touched; the counts of its code points (at most
    1,114,112) and the glyph table come to the driver."""
    counts = dict(docs.select(F.col(text).alias("text")).mapInArrow(_code_points, "cp int, n bigint").groupBy("cp").agg(F.sum("n")).collect())
    pairs = look_alikes.where("glyph is not null and plain is not null and glyph <> ''").select("glyph", "plain").limit(_MOST_GLYPHS + 1).collect()
    if len(pairs) > _MOST_GLYPHS:
        raise ValueError(f"more than {_MOST_GLYPHS} glyphs")
    rules = build([(g, p) for g, p in pairs], counts)
    return rules, touched(rules, counts)


def one_form(docs: DataFrame, look_alikes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, form): texts that look the same have equal forms.

    Full-width forms, composed and decomposed marks, blanks of category Zs, glyphs of look_alikes (columns glyph, plain) and
    characters of category Cf are taken as equal to their ordinary writing; case, digits, line breaks and numbers of
    blanks are kept. A null text has a null form, an empty one an empty form. Every row gives one row; further columns are
    ignored; texts of any length are rewritten whole. Null or empty glyphs are skipped. Classes that spell each other in a
    circle (x looks like yz, y like xz) raise ValueError.
    """
    rules, pattern = rules_for(docs, look_alikes, text)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_rewrite(rules, pattern), "id bigint, text string, form string").select(F.col("id").alias(doc_id), F.col("text").alias(text), "form")


def _looks(docs: DataFrame, look_alikes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, look, own): digests of the form and of the text, of documents with an id and a text; written once."""
    forms = one_form(docs, look_alikes, doc_id, text).where(F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    same = F.col("form") == F.col(text)
    own = F.unhex(F.sha2(F.col(text), 256))
    return written(forms.select(F.col(doc_id).alias("doc"), F.when(same, own).otherwise(F.unhex(F.sha2("form", 256))).alias("look"), own.alias("own")), "looks")


def look_classes(docs: DataFrame, look_alikes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with a text: doc_id and class_id, the least id of the documents that look the same (copies too)."""
    keys = _looks(docs, look_alikes, doc_id, text)
    least = keys.groupBy("look").agg(F.min("doc").alias("class_id"))
    return keys.join(least.hint("shuffle_hash"), "look").select(F.col("doc").alias(doc_id), "class_id")


def same_look(docs: DataFrame, look_alikes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs doc_a < doc_b of documents with different texts that look the same. Copies of one text alone make no pair."""
    keys = _looks(docs, look_alikes, doc_id, text)
    texts = keys.select("look", "own").distinct()  # copies are no partners: texts are paired first, then their documents
    a, b = (texts.select("look", F.col("own").alias(f"own_{s}")) for s in "ab")
    pairs = a.join(b, "look").where("own_a < own_b").select("own_a", "own_b")
    x, y = (keys.select(F.col("doc").alias(f"doc_{s}"), F.col("own").alias(f"own_{s}")) for s in "ab")
    both = pairs.join(x, "own_a").join(y, "own_b").where("doc_a <> doc_b")
    return both.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).distinct()
