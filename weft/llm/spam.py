"""Keyword-stuffed pages, link lists and tag lists, by rank-frequency curves and divergence from prose.

1. Lines that recur over the corpus (menus, cookie notices) are counted over distinct page bodies and left out with the footer and title.
2. One pass over the texts writes each page's own words, by line or sentence, and their frequency spectrum; all later steps read that.
3. SQL windows turn the spectrum into a rank-frequency curve, to which a line is fitted in log-log space. Slope, residual, share of the
   first rank and variety are compared with prose of the same language and like length: pages with their language's usual share of
   function words, of which more than one kind is needed to tell a language.
4. Pages far outside that also lack function words teach what is not prose, pages that are neither what is. Words several times as
   frequent in prose are the language's prose words, counted over all such pages.
5. A page is flagged if its slope, its residual or its divergence, the lack of prose words against prose of the same language and like
   length, is extreme. A flagged page is spam if more than half of its words stand in lines or sentences without their share of prose words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.text import INVISIBLE
from weft.session import stage

# Common function words of each language.
FUNCTION_WORDS = {
    "en": "the a an and or of to in is are was were be been it its that this these those with for by as at on from into than then had has have not which who what when where while until how if but so because although there their they them he she his her you your we our i my can could will would should must about after before during without between all any some each other",
    "de": "der die das den dem des ein eine einen einem einer eines und oder ist sind war waren wird werden wurde wurden im in zu zum zur mit von vom für auf aus bei nach als wie nicht nur auch noch sich es er sie wir ihr ich wenn weil daß dass aber ob durch über unter vor um an am so hat haben kann dieser diese dieses ohne seit",
    "fr": "le la les l un une et ou est sont était des du de d dans que qu qui quand pour par sur avec sans sous ne pas se si il elle ils elles on nous vous je ce cet cette ces à au aux mais donc car comme plus près après avant chez leur leurs son sa ses être avoir a ont alors parce chaque dit",
    "es": "el la los las un una unos unas y o es son era fue ser estar está estaba de del en que quien por para con sin sobre no ni se su sus al lo le les si pero porque cuando como donde más muy ya hay este esta esto ese esa aunque desde hasta entre usted ellos nos",
    "ru": "и в во не на что чтобы с со как по это к ко но а из у за от о об до для без после около перед через над под при между если то когда где кто другой каждый или же ли бы так там здесь уже еще ещё только очень он она они мы вы я его её их все всё был была было были есть",
    "ja": "の に は を た が で て と し も な か ら れ い ま す る さ だ こ そ",
}
# Encodings a page's text may have been read with, and those it may have been in.
MISREAD = tuple((wrong, right) for right in ("utf-8", "cp1251", "koi8-r", "shift_jis", "euc_jp") for wrong in ("latin-1", "cp1252", "iso8859-15", "cp1251") if wrong != right)

_FUNCTION = {g: frozenset(w.split()) for g, w in FUNCTION_WORDS.items()}
_LANGUAGES_OF: dict[str, list[str]] = {}
for _g, _f in _FUNCTION.items():
    for _w in sorted(_f):
        _LANGUAGES_OF.setdefault(_w, []).append(_g)
# single letters are too common in text read in a wrong encoding to tell that it is well read
_TELLING = frozenset(x for g, f in _FUNCTION.items() for x in f if len(x) > 1 or g == "ja")
_WORD = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]|[^\W\d_]+")
_ASCII_WORD = re.compile("[a-z]+")
# a character lost in decoding was a letter of its word
_LOST = str.maketrans("\ufffd", "\u0294")
# what text read in a wrong encoding is full of: signs of the upper half, and Latin letters beside Cyrillic ones
_MANGLED = re.compile(r"[\u0080-\u00a8\u00aa\u00ac-\u00ba\u00bc-\u00be]|Ã.|[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z]")
_UNIT = re.compile(r"[^\w\s'’]+(?:\s|$)|\s[^\w\s'’]+|\n")
_LINK = re.compile(r"https?://\S+|www\.\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}\b(?:/\S*)?")
_SENTENCE = re.compile(r"[.!?…]+(?=\s|$)|[。！？]+")
_BREAK = r"(?<=[.!?…。！？])\s*"
_CLOSED = re.compile(r"[.!?…。！？][\"'»”)\]]*$")
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: A line of more words than this is judged by its sentences.
LINE_WORDS = 12
#: Longest line, in characters, that can be a menu entry or notice.
NOTICE_CHARS = 120
#: Bytes of text turned into Python objects at once.
PART_BYTES = 4 << 20
#: Different function words without which a page is in no language: one word, however often, may be a keyword.
DISTINCT = 3


def recurring_lines(pages: DataFrame, share: float = 0.001) -> list[str]:
    """Short lines found with at least ``share`` of the texts' number of distinct bodies (two at least).

    A text's body is what does not recur in it, lines above ``NOTICE_CHARS`` taken sentence by sentence. Copies differing in a footer
    have hardly any body left, as all they share recurs; texts with less body than a quarter of their characters count for no line.
    The share is above that of a notice read in one wrong encoding: left out as it stands, it would hide that its page can be put right.
    """
    texts = pages.select("text").filter(F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    limit = max(2, share * texts.agg(F.count_distinct("h").alias("n")).first()["n"])
    lines = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS))))
    unit = lambda x, notice: F.struct(F.xxhash64(x, F.lit(notice)).alias("k"), F.length(x).alias("n"), F.lit(notice).alias("notice"))
    each = F.transform(lines, lambda x: F.when(F.length(x) <= NOTICE_CHARS, F.array(unit(x, True))).otherwise(F.transform(F.split(x, _BREAK), lambda y: unit(y, False))))
    units = stage(texts.select("h", F.explode(F.flatten(each)).alias("u")).select("h", "u.*").filter(F.col("n") > 0).distinct(), "units")
    # counted by hashes alone; no more than the lines of a text over ``share`` recur
    often = stage(units.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit).select("k", F.lit(True).alias("often")), "often")
    own = F.col("often").isNull()
    parts = units.join(F.broadcast(often), "k", "left").groupBy("h").agg(F.sum("n").alias("all"), F.sum(F.when(own, F.col("n"))).alias("own"), F.bit_xor(F.when(own, F.col("k"))).alias("body"))
    bodies = parts.filter(F.col("own") * 4 >= F.col("all")).select("h", "body")
    shown = units.filter("notice").join(F.broadcast(often), "k", "left_semi").join(bodies, "h").select("k", "body").distinct()
    kept = shown.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limit).select("k")
    found = texts.select(F.explode(lines).alias("line")).filter(F.length("line").between(1, NOTICE_CHARS)).withColumn("k", F.xxhash64("line", F.lit(True)))
    return [r["line"] for r in found.join(F.broadcast(kept), "k", "left_semi").select("line").distinct().collect()]


#: A line in lower case, and its text and words, whole if it is short, else by sentence.
Line = tuple[str, list[tuple[str, list[str]]]]


class Reader:
    """Splits a page into lines and sentences of words, without what is not its own text."""

    def __init__(self, recurring: list[str]) -> None:
        self.recurring = frozenset(recurring)
        self.entries = frozenset(e for s in recurring if 1 <= len(e := tuple(_WORD.findall(s.lower()))) <= 3)

    def _run(self, words: list[str], taken: frozenset[tuple[str, ...]]) -> frozenset[tuple[str, ...]] | None:
        """``taken`` with the entries ``words`` are a run of; None if they are none, or one of entries taken before."""
        if not words:
            return taken
        for k in range(min(3, len(words)), 0, -1):
            entry = tuple(words[:k])
            if entry in self.entries and entry not in taken and (rest := self._run(words[k:], taken | {entry})) is not None:
                return rest
        return None

    def lines(self, text: str) -> tuple[list[Line], int]:
        """The page's own lines and the number of words left out."""
        out, left_out, taken = [], 0, frozenset()
        find = _ASCII_WORD.findall if text.isascii() else _WORD.findall
        for raw in text.split("\n"):
            line = raw.strip()
            if not line:
                continue
            low = line.lower()
            parts = [low] if len(low) < 3 * LINE_WORDS else _SENTENCE.split(low)
            each = [(s, ws) for s in parts if (ws := find(s))]
            n = sum(len(ws) for _, ws in each)
            if line in self.recurring or line[0] == "©":
                left_out += n
                continue
            if n <= LINE_WORDS and len(each) != 1:
                each = [(low, [w for _, ws in each for w in ws])]
            if len(line) <= NOTICE_CHARS and (run := self._run([w for _, ws in each for w in ws], taken)) is not None:
                # a menu names an entry once, keywords come again
                taken = run
                left_out += n
            else:
                out.append((low, each))
        if len(out) > 1 and sum(len(ws) for _, ws in out[0][1]) <= 20 and not _CLOSED.search(out[0][0]):
            del out[0]  # the title
        return out, left_out

    def _read(self, text: str) -> Page:
        lines, left_out = self.lines(text)
        counts = Counter(w for _, each in lines for _, words in each for w in words)
        languages, hits = languages_of(counts)
        return Page(lines, counts, counts.total(), languages, hits, left_out)

    def page(self, text: str | None) -> Page:
        """The page, with its language by its function words; text read in a wrong encoding is put right.

        Text that cannot be put right is in no language and has no lines: there is no prose to compare it with.
        """
        if not text:
            return Page([], Counter(), 0, [], 0, 0)
        if text.isascii():
            return self._read(text)
        text = INVISIBLE.sub("", text)
        best = self._read(text.translate(_LOST) if "\ufffd" in text else text)
        beyond = len(text) - len(text.encode("ascii", "ignore"))
        foreign = beyond * 10 > len(text) and best.telling() < 0.05
        if foreign or (beyond * 100 > len(text) and len(_MANGLED.findall(text)) * 100 > len(text)):
            known, letters = best.known() + 0.02, sum(map(str.isalpha, text))
            for wrong, right in MISREAD:
                fixed = text.encode(wrong, "ignore").decode(right, "ignore")
                # a character takes up to three bytes, each read as a letter of its own
                if sum(map(str.isalpha, fixed)) * 4 > letters and (other := self._read(fixed)).known() > known:
                    best, known = other, other.known()
            if foreign and best.known() < 0.03 and garbled(text):
                return Page([], Counter(), 0, [], 0, 0)
        return best


class Page:
    """A page's own lines, the counts of their words, and its languages, the main one first (none if there are too few function words to tell)."""

    __slots__ = ("lines", "counts", "n", "languages", "hits", "left_out")

    def __init__(self, lines: list[Line], counts: Counter, n: int, languages: list[str], hits: int, left_out: int) -> None:
        self.lines, self.counts, self.n, self.languages, self.hits, self.left_out = lines, counts, n, languages, hits, left_out

    @property
    def share(self) -> float:
        """The share of its main language's function words."""
        return self.hits / max(1, self.n)

    def known(self) -> float:
        """How much of the text is known: function words and what recurs."""
        return (self.hits + self.left_out) / max(1, self.n + self.left_out)

    def telling(self) -> float:
        return sum(self.counts[w] for w in self.counts.keys() & _TELLING) / max(1, self.n)

    def segments(self) -> Iterator[tuple[bool, list[str]]]:
        """Whether it is a link, and the words, of each short line and of each sentence of the longer ones."""
        for _, each in self.lines:
            for s, ws in each:
                if ws:
                    yield len(ws) <= LINE_WORDS and "." in s and _LINK.search(s) is not None, ws

    def listed(self) -> float:
        """The share of words that stand in units of no more than five words between marks or line ends."""
        links = sum(len(ws) for link, ws in self.segments() if link)
        sizes = [len(_WORD.findall(u)) for low, _ in self.lines if not _LINK.search(low) for u in _UNIT.split(low)]
        return (links + sum(k for k in sizes if k <= 5)) / max(1, self.n)


def garbled(text: str) -> bool:
    """Whether a good part of the characters beyond ASCII are no letters, as in text read in a wrong encoding."""
    beyond = [c for c in text if c > "\x7f" and not c.isspace()]
    return sum(not c.isalpha() for c in beyond) * 5 > len(beyond) and len(beyond) * 5 > len(text)


def languages_of(counts: Counter) -> tuple[list[str], int]:
    """The language with most different function words and how often they stand in the text, then those with ``DISTINCT`` more of their own."""
    kinds: Counter = Counter()
    hits: Counter = Counter()
    found = counts.keys() & _LANGUAGES_OF.keys()
    for w in found:
        for g in _LANGUAGES_OF[w]:
            kinds[g] += 1
            hits[g] += counts[w]
    best = max(kinds, key=lambda g: (kinds[g], hits[g], g), default=None)
    if best is None or kinds[best] < DISTINCT:
        return [], 0
    rest = found - _FUNCTION[best]
    return [best, *(g for g in _FUNCTION if g != best and len(rest & _FUNCTION[g]) >= DISTINCT)], hits[best]


def _declared(lang: str | None) -> str | None:
    g = (lang or "").strip().lower()[:2]
    return g if g in _FUNCTION else None


PAGE = "doc_id bigint, lang string, langs string, share double, listed double, n int, freq array<int>, words array<int>, own string"


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of some 4 MB, a longer page alone, so that a worker holds no more of them as Python objects."""
    a, size, sizes = 0, 0, pc.binary_length(batch.column(batch.num_columns - 1)).to_pylist()
    for b, n in enumerate(sizes):
        if size and size + (n or 0) > PART_BYTES:
            yield batch.slice(a, b - a)
            a, size = b, 0
        size += (n or 0) + 200
    if a < batch.num_rows:
        yield batch.slice(a)


def _read_pages(recurring: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(recurring)
        ints = pa.list_(pa.int32())
        for batch in (part for whole in batches for part in _parts(whole)):
            out: list[list] = [[], [], [], [], [], [], [], [], []]
            for k, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True):
                page = reader.page(text)
                spectrum = sorted(Counter(page.counts.values()).items(), reverse=True)
                own = "\n".join(("\t" if link else "") + " ".join(ws) for link, ws in page.segments())
                langs = page.languages or ([g] if (g := _declared(lang)) else [])
                row = (k, langs[0] if langs else None, " ".join(langs), page.share, 0.0 if langs else page.listed(), page.n, [f for f, _ in spectrum], [m for _, m in spectrum], own)
                for c, x in zip(out, row, strict=True):
                    c.append(x)
            types = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), ints, ints, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "lang", "langs", "share", "listed", "n", "freq", "words", "own"])

    return run


def read_pages(pages: DataFrame, recurring: list[str]) -> DataFrame:
    """doc_id, lang (None where neither its words nor the table tell), langs (all it holds prose of), share of function words, listed (of a page
    of no language), n words, spectrum (freq, words) and own words of each page: a line for each short line or sentence, a link led by a tab."""
    return pages.mapInArrow(_read_pages(recurring), PAGE)


def curves(spectra: DataFrame) -> DataFrame:
    """doc_id, slope, residual, head of each page: a line through its rank-frequency curve, in logarithms."""
    points = spectra.select("doc_id", "n", F.explode(F.arrays_zip("freq", "words")).alias("p")).select("doc_id", "n", "p.freq", "p.words")
    rank = F.sum("words").over(Window.partitionBy("doc_id").orderBy(F.col("freq").desc()))
    xy = points.withColumn("x", F.log(rank)).withColumn("y", F.log(F.col("freq") / F.col("n")))
    fit = xy.groupBy("doc_id").agg(F.regr_sxx("y", "x").alias("sxx"), F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"), F.count(F.lit(1)).alias("k"), F.max(F.col("freq") / F.col("n")).alias("head"), F.log(F.sum("words") / F.max("n")).alias("variety"))
    spare = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    some = F.col("sxx") > 0
    return fit.select("doc_id", F.when(some, F.col("sxy") / F.col("sxx")).otherwise(0.0).alias("slope"), F.when(some, F.sqrt(spare / F.col("k"))).otherwise(0.0).alias("residual"), "head", "variety")


CURVE = ("slope", "residual", "head", "variety")
#: Pages of what is not prose in which a word as common there as in prose would stand, for its absence to tell anything.
EXPECTED = 8
#: Share of its language's usual function words that a page of prose has at least, and one that lacks them at most.
PROSE_SHARE, LACKING_SHARE = 0.7, 0.35


def _size(n: str = "n") -> Column:
    return F.floor(F.log2(n))


def away(rows: DataFrame, features: Iterable[str]) -> DataFrame:
    """``rows`` (lang, size, reference) with ``<feature>_z``: how far each feature lies from the reference pages of the same language and
    size, in robust deviations; sizes with less than 30 of these are compared with their language's, languages with less with all."""
    features = list(features)
    stats = [F.count(F.lit(1)).alias("m"), *(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q_{c}") for c in features)]
    # a row for each language and power of two: a few hundred at any size
    usual = stage(rows.filter("reference").rollup("lang", "size").agg(*stats).filter((F.col("m") >= 30) | F.col("lang").isNull()), "usual")
    quarts = [f"q_{c}" for c in features]
    named = lambda df, p, *keys: df.select(*keys, *(F.col(q).alias(f"{p}{q}") for q in quarts))
    out = rows.join(F.broadcast(named(usual.filter(F.col("size").isNotNull()), "a", "lang", "size")), ["lang", "size"], "left")
    out = out.join(F.broadcast(named(usual.filter(F.col("size").isNull() & F.col("lang").isNotNull()), "b", "lang")), "lang", "left")
    out = out.join(F.broadcast(named(usual.filter(F.col("lang").isNull()), "c").limit(1)), how="left")
    for c in features:
        q = F.coalesce(*(F.col(f"{p}q_{c}") for p in "abc"))
        out = out.withColumn(f"{c}_z", F.coalesce((F.col(c) - q[1]) / (F.lit(0.741) * (q[2] - q[0]) + F.lit(0.01)), F.lit(0.0)))
    return out.drop(*(f"{p}{q}" for p in "abc" for q in quarts))


def measure(read: DataFrame, limit: float = 3.0, words: int = 20) -> DataFrame:
    """doc_id, lang, size, n, share, reference, lacking and the z of each feature of the curve, of pages of at least ``words`` words.

    ``reference`` pages have their language's usual share of function words, ``lacking`` ones little of it. What is usual is the upper quartile
    over all pages of the language.
    """
    some = read.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "share", "listed", "n", "freq", "words").filter(F.col("n") >= words)
    page = some.drop("freq", "words").distinct().join(curves(some), "doc_id").withColumn("size", _size())
    # six languages and one row for pages of none
    usual = page.groupBy("lang").agg(F.percentile_approx("share", 0.75, 1000).alias("usual"))
    page = page.join(F.broadcast(usual), "lang")
    page = page.withColumn("reference", (F.col("share") > 0) & (F.col("share") >= F.col("usual") * PROSE_SHARE)).withColumn("lacking", F.col("share") <= F.col("usual") * LACKING_SHARE)
    far = away(page, CURVE)
    curve = F.greatest(*(F.abs(F.col(f"{c}_z")) for c in CURVE))
    return far.select("doc_id", "lang", "size", "n", "share", "listed", "reference", "lacking", *(f"{c}_z" for c in CURVE), (curve > limit).alias("extreme"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    pages: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(total)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64()), pa.array([pages[k] for k in keys], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "prose", "word", "n", "pages"])

    for batch in (part for whole in batches for part in _parts(whole)):
        for g, prose, own in zip(*(batch.column(c).to_pylist() for c in ("lang", "prose", "own")), strict=True):
            for w, c in Counter(own.split()).items():
                total[g, prose, w] += c
                pages[g, prose, w] += 1
        if len(total) > 300_000:  # memory of a worker
            yield out()
            total.clear()
            pages.clear()
    yield out()


def prose_words(read: DataFrame, measured: DataFrame, ratio: float = 3.0) -> tuple[dict[str, frozenset[str]], dict[str, float]]:
    """The words of each language at least ``ratio`` times as frequent in prose as in its opposite, and their share of its prose.

    Counted over all seed pages. The language's function words are among them but for those shown not to be. Another word must stand in 1 % of the prose pages, so no
    more than 100 times the words of a page come out for a language, and be missing where ``EXPECTED`` pages of the other class should have it.
    """
    prose = F.when(F.col("extreme") & F.col("lacking"), False).when(~F.col("extreme") & F.col("reference"), True)
    seeds = measured.select("doc_id", "lang", prose.alias("prose")).filter(F.col("prose").isNotNull() & (F.col("lang") != "")).distinct()
    counted = read.select("doc_id", "own").join(seeds, "doc_id").select("lang", "prose", "own").mapInArrow(_counts, "lang string, prose boolean, word string, n bigint, pages bigint").groupBy("lang", "prose", "word").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    counted = stage(counted, "counted")
    # a row for each language and class
    totals = counted.groupBy("lang", "prose").agg(F.sum("n").alias("all")).join(seeds.groupBy("lang", "prose").agg(F.count(F.lit(1)).alias("of")), ["lang", "prose"])
    totals = stage(totals, "totals")
    one = counted.filter("prose").join(F.broadcast(totals.filter("prose").drop("prose")), "lang").select("lang", "word", F.col("n").alias("a"), F.col("all").alias("a_all"), (F.col("pages") / F.col("of")).alias("a_pages"))
    two = counted.filter("NOT prose").select("lang", "word", F.col("n").alias("b"), F.col("pages").alias("b_pages"))
    sizes = totals.filter("NOT prose").select("lang", F.col("all").alias("b_all"), F.col("of").alias("b_of"))
    both = one.join(two, ["lang", "word"], "left").join(F.broadcast(sizes), "lang", "left").fillna(0, ["b", "b_all", "b_of", "b_pages"])
    expected, pages = F.col("a") / F.col("a_all") * (F.col("b_all") + 1), F.col("a_pages") * F.col("b_of")
    # a page repeats its keywords, so evidence is counted in pages as well
    enough = pages >= EXPECTED
    told = (expected >= ratio * (F.col("b") + 0.5)) & (pages >= ratio * F.col("b_pages"))
    function = F.create_map(*(x for g, f in _FUNCTION.items() for x in (F.lit(g), F.array(*map(F.lit, sorted(f))))))
    common = F.coalesce(F.array_contains(F.element_at(function, F.col("lang")), F.col("word")), F.lit(False))
    kept = both.filter(common | ((F.col("a_pages") >= 0.01) & enough & told)).select("lang", "word", (F.col("a") / F.col("a_all")).alias("rate"), (common & enough & ~told).alias("shown_not")).collect()
    words: dict[str, set[str]] = {g: set(_FUNCTION[g]) for g in {r["lang"] for r in kept}}
    usual: dict[str, float] = {}
    for r in kept:
        if r["shown_not"]:
            words[r["lang"]].discard(r["word"])
        else:
            words[r["lang"]].add(r["word"])
            usual[r["lang"]] = usual.get(r["lang"], 0.0) + r["rate"]
    return {g: frozenset(words[g]) for g in usual}, usual


DIVERGENCE = "doc_id bigint, n int, outside int, divergence double"


def _outside(segments: list[list[str]], links: int, languages: list[tuple[frozenset[str], float]], part: float) -> tuple[int, float]:
    """The number of words outside prose, and how much of its usual share of prose words the page lacks.

    A segment is taken in the language, of those of which ``DISTINCT`` prose words (two below 30 words) stand on the page, that suits it best.
    """
    seen = {w for ws in segments for w in ws}
    least = min(DISTINCT, max(2, sum(map(len, segments)) // 10))
    of = [(words, usual) for words, usual in languages if len(seen & words) >= least]
    n, outside, inside = links, links, 0.0
    for ws in segments:
        k = len(ws)
        n += k
        had = max((sum(map(words.__contains__, ws)) / usual for words, usual in of), default=0.0)
        inside += had
        if had < part * k:
            outside += k
    return outside, 1.0 - inside / max(1, n)


def _divergences(words: dict[str, frozenset[str]], usual: dict[str, float], part: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {g: (words[g], usual[g]) for g in words}
        for batch in (part for whole in batches for part in _parts(whole)):
            ids, sizes, outside, divergence = [], [], [], []
            for k, langs, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "langs", "own")), strict=True):
                lines = own.split("\n") if own else []
                segments = [s.split(" ") for s in lines if s[0] != "\t"]
                links = sum(s.count(" ") + 1 for s in lines if s[0] == "\t")
                # a page of no known language may be of any
                out, lack = _outside(segments, links, [of[g] for g in langs.split() if g in of] or list(of.values()), part)
                ids.append(k)
                sizes.append(sum(map(len, segments)) + links)
                outside.append(out)
                divergence.append(lack)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(outside, pa.int32()), pa.array(divergence, pa.float64())], names=["doc_id", "n", "outside", "divergence"])

    return run


def judge(pages: DataFrame, part: float = 0.45, limit: float = 3.0, words: int = 20) -> DataFrame:
    """doc_id, lang, n, slope_z, residual_z, divergence_z, flagged, outside of every page of at least ``words`` words of its own.

    ``flagged`` pages have a slope, residual (or another feature of their curve) or divergence more than ``limit`` robust deviations from prose of their language
    and like length; ``outside`` is the share of words that stand in lines or sentences with less than ``part`` of the usual prose words, or in links.
    Null, empty and shorter texts give no row; rows repeated under one doc_id each give a row or more; texts of any length are read
    whole; an empty table gives no row; further columns are ignored. The divergence of a page of no known language flags it only if most
    of its words stand in units of five or less, as in lists: there is no prose to compare it with.
    """
    own = pages.select(F.col("doc_id").cast("bigint"), "lang", "text").filter(F.col("doc_id").isNotNull())
    read = stage(read_pages(own, recurring_lines(own)), "pages")
    measured = stage(measure(read, limit, words), "measured")
    prose, usual = prose_words(read, measured)
    share = read.filter(F.col("n") >= words).select("doc_id", "langs", "own").mapInArrow(_divergences(prose, usual, part), DIVERGENCE)
    both = stage(measured.drop("n").join(share, "doc_id"), "divergence")
    far = away(both, ["divergence"])
    flagged = F.col("extreme") | ((F.col("divergence_z") > limit) & ((F.col("lang") != "") | (F.col("listed") > 0.5)))
    return far.select("doc_id", "lang", "n", "slope_z", "residual_z", "divergence_z", "extreme", flagged.alias("flagged"), (F.col("outside") / F.col("n")).alias("outside"))


def find_spam(pages: DataFrame, share: float = 0.5, words: int = 20) -> DataFrame:
    """doc_id of the flagged pages of at least ``words`` words of which more than ``share`` are not prose."""
    return judge(pages, words=words).filter(F.col("flagged") & (F.col("outside") > share)).select("doc_id").distinct()
