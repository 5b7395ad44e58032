"""Personal information in free text: bootstrapped contextual extraction and typed placeholders.

1. One scan of the texts extracts candidate mentions by generous shapes, each with its instance nodes (the words of
   a name, the shape of a number, the street and the form of an address) and its pattern nodes (what stands left and right).
   Seed entities are mentions that announce themselves: signed-off or author trailers, numbers after the name
   of an identity document or a word for telephone, numbers with a country prefix, a house number before a street with a common ending.
2. Mentions are counted into a graph of patterns and instances. In every round Spark scores each node by the share
   of its mentions that are accepted so far, and accepted nodes accept further mentions: patterns induced from
   the seeds find new names and number formats, and these find new patterns.
3. Mentions whose nodes are accepted are reported, and replaced by placeholders on request.

Mail addresses are recognised by their own form, plain or disguised, and need no graph.
The graph is aggregated before every join; accepted nodes are broadcast only below a checked number of rows, else joined by
a shuffle. Texts are never cut, and every pattern takes time in proportion to the text: parts of a number need a mark between
them, runs of letters are taken whole, and no match begins inside a word.

Texts are redacted where they were read: the scan that extracts candidates also stores the texts with their candidates, and a second
scan decides them by the broadcast nodes, so no text is shuffled (beyond the checked number of nodes texts meet their spans by row number).

What is a number here: 6 to 20 digits and 7 characters; after the name of an identity document 4 digits and 5 characters. A house
number has at most 5 digits before a street and 4 behind it.

Defined results: null and empty texts give no mention; lines are divided at LF and counted from 1; a mention never
crosses a line end; several mentions of a kind in a line are one row of ``places``; repeated documents give
their rows once per doc_id, and each of their texts is redacted by its own mentions, as are texts without a doc_id; mentions that overlap are
replaced together by one placeholder, of the longest one's kind; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import logging
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.session import cut, write_once

#: Rounds end early if one changes nothing; the log says so if after this many the last still changed something.
ROUNDS = 5
#: Accepted nodes of up to this many rows (about 40 bytes each) are broadcast.
BROADCAST_NODES = 200_000

# Word lists of public conventions.
_FILE_ENDINGS = "png|jpe?g|gif|svg|webp|ico|css|jsx?|tsx?|py|go|rs|java|html?|json|ya?ml|xml|md|txt|sh|sql|whl|gz|zip|tar|exe|so|dll"
_IDENTITY = (
    r"ssn|social\s+security(?:\s+(?:number|no\.?))?|passport(?:\s+(?:number|no\.?))?|national\s+id(?:entity)?(?:\s+(?:number|no\.?))?|"
    r"tax\s+(?:id|number|no\.?)|ni\s+(?:number|no\.?)|national\s+insurance(?:\s+(?:number|no\.?))?|personal\s+(?:code|number)|"
    r"driving\s+licen[cs]e|driver'?s?\s+licen[cs]e|id\s+card(?:\s+(?:number|no\.?))?|ausweisnr\.?|personalausweis"
)
_STREET_WORDS = (
    "street|st|road|rd|avenue|ave|lane|ln|drive|dr|court|ct|boulevard|blvd|terrace|place|pl|square|sq|way|close|crescent|row|parkway|highway"
)
_STREET_ENDINGS = "strasse|straße|str|weg|gasse|allee|platz|ufer|vej|gade|gatan|vägen|straat|laan|plein"
_STREET_PREFIXES = "rue|calle|via|avenida|rua|avenue|boulevard|chemin|place|plaza|piazza|ulica|ul"
_TRAILERS = r"signed-off-by:|co-authored-by:|reviewed-by:|acked-by:|author:|@author|maintainer:|written\s+by|thanks\s+to|todo\(|fixme\("



def _openers() -> str:
    """Ranges of the letters beyond U+017E with which a name may begin: capitals, and letters of scripts without letter case."""
    ranges, last = [], -2
    for c in range(0x17F, sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind in ("Lu", "Lt") or kind == "Lo" and c > 0x24F or 0x10D0 <= c <= 0x10FF and kind == "Ll":  # Georgian is written without capitals
            if c == last + 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
            last = c
    return "".join(chr(a) + ("-" + chr(b) if b > a else "") for a, b in ranges)


#: Letters with which a name may begin, of all scripts. Patterns begin with it, so that the search skips to the next one, and look back
#: from there: a match within a word or behind a hyphen is never wanted, and trying it at every letter of a long word would take long.
_UP = r"[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ]"
_UP_ANY = rf"{_UP[:-1]}{_openers()}]"
_WORD_REST = r"[^\W\d_]*+(?:['’\-][^\W\d_]++)*"
_CAP = rf"{_UP}{_WORD_REST}"
_INSIDE = r"(?<![^\W_]['’][\s\S])"
_PARTICLE = r"(?:(?:[Vv]an|[Vv]on|[Dd]e|[Dd]er|[Dd]en|[Dd]el|[Dd]i|[Dd]a|[Dd]u|[Ll]e|[Ll]a|[Tt]er|[Tt]en|[Ee]l|[Aa]l|VAN|VON|DE|DER|DEL|DI|DA|DU|LE|LA)[ ])"

_DOT = r"(?:\.|[^\S\n]?[\[({]\s?(?:dot|DOT|Dot)\s?[\])}][^\S\n]?|[^\S\n](?:dot|DOT)[^\S\n])"
_HARD_AT = r"(?:@|＠|%40|&#64;|&commat;|[^\S\n]?[\[({<]\s?(?:at|AT|At|@)\s?[\])}>][^\S\n]?|[^\S\n]@[^\S\n])"
_LOCAL = r"[^\W_](?:[\w.+\-]*\w)?"
_LABEL = r"[^\W_](?:(?:[^\W_]|-)*[^\W_])?"
_DOMAIN = rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,24}}"
_EMAIL = re.compile(rf"(?<![\w.+\-]){_LOCAL}{_HARD_AT}{_DOMAIN}(?![\w\-])")
_SOFT_EMAIL = re.compile(
    rf"(?<![\w.+\-]){_LOCAL}[^\S\n](?:at|AT)[^\S\n][\w\-]+(?:[^\S\n](?:dot|DOT)[^\S\n][\w\-]+)+(?![\w\-])"
)
_COMMON_ENDING = re.compile(r"\s(?:com|org|net|edu|gov|io|dev|info|example|test|invalid|uk|de|fr|nl|it|es|pl|eu|us|ca|au|jp|in|br|ch|at|se|no|dk|fi)$", re.I)
_CREDENTIALS = re.compile(r"(?<=[A-Za-z0-9+.\-])://[^\s/\"'<>]*")
_FILE_LIKE = re.compile(rf"\.(?:{_FILE_ENDINGS})$", re.I)
_MAYBE_EMAIL = re.compile(r"@|＠|%40|&#64;|&commat;|[\[({<] ?(?:at|AT|At) ?[\])}>]")

_RUN = r"[0-9][0-9A-Z]*+\)?"
_NUMBER_FORM = (
    rf"(?:\+|\()?(?:[A-Z]{{1,2}}[ ]?)?\(?{_RUN}(?:(?:[ .\-/]\(?|[ ]?\(|(?<=\))){_RUN})*(?:[ ]?[A-Z](?![\w]))?"
    r"(?:[ ]?(?:ext\.?|x)[ ]?[0-9]{1,5})?(?![\w@%])"
)
_NUMBER = re.compile(r"(?<![\w@%#$.+\-/\\=&])" + _NUMBER_FORM)
#: A number directly after such a mark is one only if what stands before the mark announces it.
_MARKED_NUMBER = re.compile(r"[=#](" + _NUMBER_FORM + ")")
_KEYED = re.compile(rf"(?:{_IDENTITY})\s*[:=#]?\s*[\"']?$", re.I)
_CALLED = re.compile(r"(?<!\w)(?:tel(?:ephone)?|phone|fax|mobile|cell|call)(?:\s+(?:number|no))?\s*[.:=#]?\s*[\"']?$", re.I)
_NAME = re.compile(
    rf"({_UP}(?<![\w@%\-][\s\S]){_INSIDE}{_WORD_REST}+)(?=(,?)[ ]((?:{_UP}\.[ ])?)({_PARTICLE}{{0,2}}{_CAP})(?![\w@]|['’]\w))"
)
_INITIAL = re.compile(rf"({_UP})\.[ ](?:{_UP}\.[ ])?({_PARTICLE}{{0,2}}{_CAP})(?![\w@]|['’]\w)")
#: What follows a street, but not a given name after a comma.
_NUMBERED = re.compile(rf"(?:[ ]{_CAP}){{0,2}}\.?\s[0-9]")
_PARTICLES = re.compile(rf"(?<![\w'’@%\-]){_PARTICLE}{{1,2}}$")
_TRAILED = re.compile(rf"(?:{_TRAILERS})\s*(?:(?:Dr|Prof|Mr|Mrs|Ms)\.\s)?(?:{_UP}\.\s)?$", re.I)
_BEFORE = re.compile(
    rf"(?<![\w.\-/:@])([0-9]{{1,5}}[a-z]?)[ ](?:([^\W\d_A-Z]{{2,9}})[ ](?:(?:de|du|des|la|del)[ ])*)?({_CAP}(?:[ ]{_CAP}){{0,3}})(\.?)"
)
_AFTER = re.compile(rf"({_UP}(?<![\w][\s\S])(?<![^\W\d_]-[\s\S]){_INSIDE}{_WORD_REST}(?:[ ]{_CAP}){{0,2}})(\.?)[ ]([0-9]{{1,4}}[a-z]?)(?![\w.\-/:])")
_WORD_BEFORE = re.compile(r"(?<!\w)([^\W\d_A-Z]{2,9})[ ](?:(?:de|du|des|la|del)[ ])*$")
_COMPOUND = re.compile(rf"^(.{{3,}}?)(?:[ \-])?({_STREET_ENDINGS})$", re.I)
_STREET = re.compile(rf"^(?:{_STREET_WORDS})$", re.I)
_PREFIX = re.compile(rf"^(?:{_STREET_PREFIXES})$", re.I)
_LATIN = (_NAME, _INITIAL, _TRAILED, _BEFORE, _AFTER, _NUMBERED)
#: The same for letters of all scripts, which take longer and are for texts that hold such letters.
_ANY = tuple(re.compile(p.pattern.replace(_UP, _UP_ANY), p.flags) for p in _LATIN)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|[\t]")


def _norm(t: str) -> str:
    return "9" if t[0].isdigit() else t.lower()


def _left(text: str, at: int, low: int) -> str:
    """The last one or two tokens before a place of its line, however long they are."""
    reach = 40
    while True:
        start = max(low, at - reach)
        got = _TOKEN.findall(text, start, at)
        if start == low or len(got) > 2:
            break
        reach *= 4
    got = got[-2:]
    if not got:
        return "^"
    return _norm(got[-1]) if got[-1][0].isalpha() else " ".join(map(_norm, got if len(got) > 1 else ["^", *got]))


def _right(text: str, at: int, high: int) -> str:
    reach = 40
    while True:
        end = min(high, at + reach)
        got = _TOKEN.findall(text, at, end)
        if end == high or len(got) > 2:
            break
        reach *= 4
    got = got[:2]
    if not got:
        return "$"
    return _norm(got[0]) if got[0][0].isalpha() else " ".join(map(_norm, got if len(got) > 1 else [*got, "$"]))


def _word_end(text: str, at: int, low: int) -> int:
    """The place behind the last character before ``at`` that is neither blank nor a mark between a label and its value."""
    while at > low and text[at - 1] in " \t:=#\"'":
        at -= 1
    return at


def _free(text: str, at: int, marks: str) -> bool:
    """Whether a word may begin here: not within a word, after one of the marks or after an apostrophe within a word."""
    before = text[at - 1 : at]
    if not before:
        return True
    return not (before.isalnum() or before == "_" or before in marks or before in "'’" and (text[at - 2 : at - 1].isalnum()))


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of mail addresses, plain or disguised, without credentials in URLs and names of files or packages."""
    spans, done = [], -1
    for hint in _MAYBE_EMAIL.finditer(text):  # only the lines that hold a sign of an address are searched
        if hint.start() < done:
            continue
        low, done = text.rfind("\n", 0, hint.start()) + 1, text.find("\n", hint.end())
        done = len(text) if done < 0 else done
        urls = [m.span() for m in _CREDENTIALS.finditer(text, low, done)]
        k = 0
        for m in _EMAIL.finditer(text, low, done):
            a, b = m.span()
            while k < len(urls) and urls[k][1] < a:
                k += 1
            if _FILE_LIKE.search(m.group()) or k < len(urls) and urls[k][0] < a or text[a - 1 : a] == "@":
                continue
            spans.append((a, b))
    if " DOT " in text or " dot " in text:
        taken = _Spans(spans)
        for m in _SOFT_EMAIL.finditer(text):
            # in small letters the words are ordinary ones: an odd mailbox or a common ending must say that it is an address
            sure = " DOT " in m.group() or re.search(r"[0-9._+\-]", m.group().split(" ")[0]) or _COMMON_ENDING.search(m.group())
            if sure and not taken.touch(*m.span()):
                spans.append(m.span())
    return spans


class _Spans:
    """Spans of a text that do not overlap each other, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def touch(self, a: int, b: int) -> bool:
        k = bisect_right(self.ends, a)
        return k < len(self.starts) and self.starts[k] < b


def mentions(text: str) -> list[tuple]:
    """(kind of graph, start, end, node a, node b, left, right, seed class) of every candidate in a text."""
    out: list[tuple] = []
    mail = emails(text)
    for a, b in mail:
        out.append(("email", a, b, "", "", "", "", "email"))
    if mail:  # nothing else is looked for inside an address
        parts, at = [], 0
        for a, b in sorted(mail):
            parts += [text[at:a], "~" * (b - a)]
            at = b
        text = "".join([*parts, text[at:]])
    ends = [m.start() for m in re.finditer("\n", text)]

    def bounds(a: int) -> tuple[int, int]:
        k = bisect_right(ends, a - 1) if a else 0
        return (ends[k - 1] + 1 if k else 0), (ends[k] if k < len(ends) else len(text))

    def add(kind: str, a: int, b: int, x: str, y: str, seed: str | None) -> None:
        low, high = bounds(a)
        out.append((kind, a, b, x, y, _left(text, a, low), _right(text, b, high), seed))

    name_form, initial_form, trailed_form, before_form, after_form, numbered_form = _LATIN if text.isascii() or max(text) < "\u017f" else _ANY
    marked = []
    for m in _MARKED_NUMBER.finditer(text):
        a, b = m.span(1)
        if b - a < 5:
            continue
        low = max(bounds(a)[0], (p := _word_end(text, a, bounds(a)[0])) - 48)
        if p > low and (_KEYED.search(text, low, a) or b - a >= 7 and _CALLED.search(text, low, a)):
            marked.append((a, b))
    numbers = [m.span() for m in _NUMBER.finditer(text)]
    if marked:
        taken = _Spans(marked)
        numbers = [*marked, *(x for x in numbers if not taken.touch(*x))]
    for a, b in numbers:
        if b - a < 5:
            continue
        if text[b - 1] == ")" and (text[a] == "(" and text.find(")", a) == b - 1 or text.count(")", a, b) > text.count("(", a, b)):
            b -= 1
        if text[a] == "(" and text.find(")", a, b) < 0:
            a += 1
        low = bounds(a)[0]
        end = _word_end(text, a, low)
        # the label of a number ends in a letter or a full stop
        named = end > low and (text[end - 1].isalpha() or text[end - 1] == ".")
        if b - a < 7 and not named:
            continue
        s = text[a:b]
        digits = sum(c.isdigit() for c in s)
        low = max(low, end - 48)
        keyed = named and 4 <= digits <= 20 and len(s) >= 5 and _KEYED.search(text, low, a)
        if not keyed and (not 6 <= digits <= 20 or len(s) < 7):
            continue
        shape = re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "9", re.sub(r"[ ]?(?:ext\.?|x)[ ]?[0-9]+$", "", s)))
        if keyed:
            seed = "id_number"
        elif 7 <= digits <= 15 and named and _CALLED.search(text, low, a):
            seed = "phone"
        elif re.match(r"(?:\+|00)(?:[17]|[2-9][0-9]{1,2})[ .\-(]|\+[1-9][0-9]{9,13}$", s) and digits >= 9:
            seed = "phone"
        else:
            seed = None
        add("number", a, b, shape, re.sub(r"[ \-]", "", shape), seed)
    for m in name_form.finditer(text):
        a, b = m.start(), m.end(4)
        if not _free(text, a, "@%-"):
            continue
        first, comma, _, last = m.groups()
        if comma and numbered_form.match(text, b):
            continue  # a flat, a unit or a street after a name
        low, _ = bounds(a)
        if p := _PARTICLES.search(text, max(low, a - 12), a):
            a, first = p.start(), text[p.start() : a] + first
        given, family = (last, first) if comma else (first, last)
        seed = "name" if trailed_form.search(text, max(low, _word_end(text, a, low) - 40), a) else None
        add("name", a, b, "g:" + given.lower(), "f:" + family.lower(), seed)
    for m in initial_form.finditer(text):
        if not _free(text, m.start(), ".@%-"):
            continue
        low, _ = bounds(m.start())
        seed = "name" if trailed_form.search(text, max(low, _word_end(text, m.start(), low) - 40), m.start()) else None
        add("name", m.start(), m.end(), "", "f:" + m.group(2).lower(), seed)
    for m in before_form.finditer(text):
        words = m.group(3).split(" ")
        if m.group(2):
            stem, form, end = words[0], f"{m.group(2).lower()} _", m.start(3) + len(words[0])
            add("address", m.start(), m.end(3), "s:" + m.group(3).lower(), form, "address" if _PREFIX.match(m.group(2)) else None)
            continue
        for k in range(1, min(len(words), 4)):
            end = m.start(3) + len(" ".join(words[: k + 1]))
            seed = "address" if _STREET.match(words[k]) else None
            add("address", m.start(), end, "s:" + " ".join(words[:k]).lower(), "_ " + words[k].lower(), seed)
    for m in after_form.finditer(text):
        if not _free(text, m.start(), ""):
            continue
        words, (low, _) = m.group(1), bounds(m.start())
        if w := _WORD_BEFORE.search(text, max(low, m.start() - 24), m.start()):
            add("address", w.start(1), m.end(), "s:" + words.lower(), f"{w.group(1).lower()} _ 9", None)
        if c := _COMPOUND.match(words):
            add("address", m.start(), m.end(), "s:" + c.group(1).lower(), "_" + c.group(2).lower() + " 9", None)
    return out


_FIELDS = ("line_no bigint", "at bigint", "upto bigint", "graph string", "a string", "b string", "before string", "after string", "seed string")
_FOUND = "array<struct<" + ", ".join(f.replace(" ", ": ") for f in _FIELDS) + ">>"


def _extract(batches: Iterable, keep: bool) -> Iterator:
    """A row per text with its candidates; texts without any are left out unless texts are kept."""
    import pyarrow as pa
    from pyspark import TaskContext

    types = [pa.int64()] * 3 + [pa.string()] * 6
    names = [f.split()[0] for f in _FIELDS]
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        picked, sizes, found = [], [0], []
        for k, t in enumerate(batch.column(1).to_pylist()):
            line, at = 1, 0
            for m in sorted(mentions(t), key=lambda m: m[1]) if t else ():
                line, at = line + t.count("\n", at, m[1]), m[1]
                found.append((line, m[1], m[2], m[0], *m[3:]))
            if keep or len(found) > sizes[-1]:
                picked.append(k)
                sizes.append(len(found))
        if not picked:
            continue
        values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 9, types)], names=names)
        own = [pa.array([row + k for k in range(len(picked))], pa.int64()), batch.column(0).take(pa.array(picked))]
        own += [batch.column(1)] if keep else []
        row += len(picked)
        yield pa.record_batch(
            [*own, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)], names=["row", "doc_id", *(["text"] if keep else []), "found"]
        )


def _maybe_broadcast(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes


#: A node is accepted by its share of accepted mentions and their number of different surroundings: instances, patterns,
#: and instances by the share of mentions whose other instance is accepted.
INSTANCE_SHARE, INSTANCE_LEAST, NUMBER_LEAST = 0.1, 1, 2
PARTNER_SHARE, PARTNER_LEAST = 0.25, 3
PATTERN_SHARE, PATTERN_LEAST = 0.4, 3
#: Least share of a pattern's accepted mentions that are of its most frequent kind.
PURE = 0.9


class Bootstrap:
    """Candidate mentions of a table of texts and the rounds that accept them; with ``keep`` the texts can be redacted."""

    def __init__(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", rounds: int = ROUNDS, keep: bool = False):
        read = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
        schema = f"row bigint, doc_id bigint, {'text string, ' if keep else ''}found {_FOUND}"
        self.keep, self.texts = keep, write_once(read.mapInArrow(lambda b: _extract(b, keep), schema), "mentions")
        self.mentions = self.texts.select("row", "doc_id", F.inline("found"))
        edges = cut(
            self.mentions.where("graph <> 'email'")
            .groupBy("graph", "a", "b", "before", "after")
            .agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
            .withColumns({"kind": F.col("seed"), "kind_a": F.lit(None).cast("string"), "kind_b": F.lit(None).cast("string"), "near": F.lit(False)})
        )
        self.settled = not rounds
        for _ in range(rounds):
            edges = cut(self._accept(edges, self._score(edges)))
            self.settled = edges.where("changed").isEmpty()
            if self.settled:
                break
        if not self.settled:
            logging.getLogger(__name__).warning("round %d still changed accepted mentions", rounds)
        self.edges, self.nodes = edges, self._score(edges)

    @staticmethod
    def _score(edges: DataFrame) -> DataFrame:
        """(graph, side, node, kind, share, near): accepted nodes, and shapes of numbers (near) that stand in accepted patterns."""
        pair = F.when(F.col("graph") != "number", F.col("graph"))

        def side(s: str, c: str, other: str | None) -> Column:
            partner = F.when(F.col(other).isNotNull(), pair) if other else F.lit(None).cast("string")
            return F.struct(F.lit(s).alias("side"), F.col(c).alias("node"), partner.alias("partner"))

        sides = F.array(
            side("a", "a", "kind_b"), side("b", "b", "kind_a"), side("l", "before", None), side("r", "after", None)
        )
        long = edges.select("graph", "n", "kind", "near", F.explode(sides).alias("x")).where("x.node <> ''")
        sums = long.groupBy("graph", "x.side", "x.node", "kind").agg(
            F.sum("n").alias("n"),
            F.count("*").alias("edges"),
            F.sum(F.when(F.col("x.partner").isNotNull(), F.col("n")).otherwise(0)).alias("beside"),
            F.count("x.partner").alias("partners"),
            F.sum(F.when(F.col("near"), F.col("n")).otherwise(0)).alias("near"),
            F.count_if("near").alias("nears"),
        )
        own = F.col("kind").isNotNull()
        whole = sums.groupBy("graph", "side", "node").agg(
            F.sum("n").alias("total"),
            F.sum(F.when(own, F.col("edges")).otherwise(0)).alias("support"),
            F.max(F.when(own, F.struct("n", "kind"))).alias("best"),
            F.sum(F.when(own, F.col("n")).otherwise(0)).alias("known"),
            F.sum("beside").alias("beside"),
            F.sum("partners").alias("partners"),
            F.sum("near").alias("near"),
            F.sum("nears").alias("nears"),
        )
        share = F.coalesce(F.col("best.n"), F.lit(0)) / F.col("total")
        instance = F.col("side").isin("a", "b")
        least = F.when(F.col("graph") == "number", NUMBER_LEAST).otherwise(INSTANCE_LEAST)
        by_share = F.when(instance, (share >= INSTANCE_SHARE) & (F.col("support") >= least)).otherwise(
            (share >= PATTERN_SHARE) & (F.col("support") >= PATTERN_LEAST) & (F.col("best.n") >= PURE * F.col("known"))
        )
        by_partner = instance & (F.col("beside") / F.col("total") >= PARTNER_SHARE) & (F.col("partners") >= PARTNER_LEAST)
        near = (F.col("graph") == "number") & (F.col("side") == "a") & (F.col("near") / F.col("total") >= INSTANCE_SHARE) & (F.col("nears") >= NUMBER_LEAST)
        kind = F.when(by_share, F.col("best.kind")).when(by_partner, F.col("graph"))
        return cut(
            whole.where(by_share | by_partner | near).select("graph", "side", "node", kind.alias("kind"), share.alias("share"), near.alias("near"))
        )

    @staticmethod
    def _beside(df: DataFrame, nodes: DataFrame) -> DataFrame:
        """Adds the kind of each side's accepted node."""
        for side, c in (("a", "a"), ("b", "b"), ("l", "before"), ("r", "after")):
            more = [F.col("near").alias("near_a")] if side == "a" else []
            own = nodes.where(F.col("side") == side).select("graph", F.col("node").alias(c), F.col("kind").alias(f"kind_{side}"), *more)
            df = df.join(_maybe_broadcast(own), ["graph", c], "left")
        return df

    @staticmethod
    def _decide() -> Column:
        """The kind of a mention by its accepted nodes, or null: for names and streets both instances, or one of them in an
        accepted pattern; for numbers the shape, or the same shape without blanks if this one is known from accepted patterns, or the pattern."""
        both = F.col("kind_a").isNotNull() & F.col("kind_b").isNotNull()
        one = F.col("kind_a").isNotNull() | F.col("kind_b").isNotNull()
        context = F.col("kind_l").isNotNull() | F.col("kind_r").isNotNull()
        by_initial = (F.col("a") == "") & F.col("kind_b").isNotNull()
        pair = F.when(both | by_initial | (one & context), F.col("graph"))
        # telephone numbers are written with their blanks
        compact = F.when((F.col("kind_b") == "id_number") & (F.coalesce("near_a", F.lit(False)) | context), F.col("kind_b"))
        return F.when(F.col("graph") == "number", F.coalesce("kind_a", compact, "kind_l", "kind_r")).otherwise(pair)

    def _accept(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        state = ("kind", "kind_a", "kind_b")
        was = {c: f"was_{c}" for c in state}
        got = self._beside(edges.drop("changed", "near").withColumnsRenamed(was), nodes)
        got = got.withColumns({"kind": F.coalesce("seed", self._decide()), "near": F.col("kind_l").isNotNull() | F.col("kind_r").isNotNull()})
        changed = ~reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(was[c])) for c in state))
        return got.select("graph", "a", "b", "before", "after", "n", "seed", *state, "near", changed.alias("changed"))

    def _decided(self) -> DataFrame:
        """Every mention that is accepted, with the row of its text."""
        columns = ("row", "doc_id", "line_no", "at", "upto")
        mail = self.mentions.where("graph = 'email'").select(*columns, F.lit("email").alias("kind"))
        rest = self._beside(self.mentions.where("graph <> 'email'"), self.nodes)
        rest = rest.withColumn("kind", F.coalesce("seed", self._decide())).where("kind IS NOT NULL")
        return mail.unionByName(rest.select(*mail.columns))

    def accepted(self) -> DataFrame:
        """Every accepted mention with its place."""
        return self._decided().drop("row")

    def places(self) -> DataFrame:
        """(doc_id, line_no, kind), once each."""
        return self.accepted().select("doc_id", "line_no", "kind").distinct()

    def redacted(self) -> DataFrame:
        """(doc_id, text) of every text, with a typed placeholder at its accepted mentions and otherwise unchanged."""
        if not self.keep:
            raise ValueError("the texts were not kept")
        nodes = self.nodes.select("graph", "side", "node", "kind", "near").limit(BROADCAST_NODES + 1).collect()
        if len(nodes) <= BROADCAST_NODES:
            shared = self.texts.sparkSession.sparkContext.broadcast({(r.graph, r.side, r.node): (r.kind, r.near) for r in nodes})
            return self.texts.select("doc_id", "text", "found").mapInArrow(lambda b: _replace_all(b, lambda m: _kind_of(m, shared.value)), _REDACTED)
        spans = self._decided().groupBy("row").agg(F.collect_list(F.struct("at", "upto", "kind")).alias("found"))
        beside = self.texts.select("row", "doc_id", "text").join(spans, "row", "left")
        return beside.select("doc_id", "text", "found").mapInArrow(lambda b: _replace_all(b, lambda m: m["kind"]), _REDACTED)


_REDACTED = "doc_id bigint, text string"


def _kind_of(m: dict, nodes: dict) -> str | None:
    """What ``Bootstrap._decide`` says, for a single mention."""
    graph = m["graph"]
    if m["seed"] or graph == "email":
        return m["seed"]
    nothing = (None, False)
    sides = (("a", "a"), ("b", "b"), ("l", "before"), ("r", "after"))
    (a, near), (b, _), (left, _), (right, _) = (nodes.get((graph, side, m[c]), nothing) for side, c in sides)
    if graph == "number":
        return a or (b if b == "id_number" and (near or left or right) else None) or left or right
    return graph if a and b or not m["a"] and b or (a or b) and (left or right) else None


def replace_spans(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """The text with a placeholder for every span; spans that overlap are one, of the kind of the longest (of these the first)."""
    parts, done, low, high, best = [], 0, 0, -1, (0, "")
    for a, b, kind in [*sorted(spans, key=lambda s: (s[0], -s[1])), (len(text) + 1, len(text) + 1, "")]:
        if a < high:
            high, best = max(high, b), max(best, (b - a, kind), key=lambda x: x[0])
            continue
        if high >= 0:
            parts += [text[done:low], f"[{best[1].upper()}]"]
            done = high
        low, high, best = a, b, (b - a, kind)
    return "".join([*parts, text[done:]])


def _replace_all(batches: Iterable, kind_of) -> Iterator:
    import pyarrow as pa

    for b in batches:
        out = []
        for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            spans = [(m["at"], m["upto"], k) for m in found or () if (k := kind_of(m))]
            out.append(replace_spans(t, spans) if t and spans else t)
        yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])
