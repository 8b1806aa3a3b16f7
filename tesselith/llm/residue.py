"""Problem 5: template residue and error pages in place of, or beside, real text.

Unfilled placeholders are found by one small grammar per delimiter; filler by its words and its repetition;
error pages and notices by what they say, and by structure: technical words, failures, requests to the reader and
traces of a server that meet in two sentences none of which commands as enacted text does. One
automaton over the lower-cased text, white space flattened, finds literals that the grammars require, so that they run on few.
A placeholder inside a code block, or in a sentence that explains how to fill in such a place, is discounted
unless placeholders are dense in the whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from operator import and_
from re import _constants as C
from re import _parser as P

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselith.sources.tables import table

_NAME = r"[A-Za-z][A-Za-z0-9_.\- ]{0,60}"

#: One grammar for each delimiter.
PLACEHOLDERS = {
    "double_brace": rf"\{{\{{\s*{_NAME}\s*\}}\}}",
    "block": rf"\{{%\s*{_NAME}\s*%\}}",
    "dollar": rf"\$\{{\s*{_NAME}\s*\}}",
    "brace": rf"(?<![{{$%])\{{\s*{_NAME}\s*\}}(?!\}})",
    "double_angle": rf"<<\s*{_NAME}\s*>>",
    "angle": r"<\s*(?:insert|enter|your|name|date|add|type|fill)\b[^<>]{0,60}>",
    "percent": rf"%%\s*{_NAME}\s*%%",
    "at": rf"@@\s*{_NAME}\s*@@",
    "hash": rf"##\s*{_NAME}\s*##",
    "guillemet": rf"«\s*{_NAME}\s*»",
    "bullet": r"\[\s*[•●◦*·]\s*[A-Za-z0-9 _-]{0,60}\]",
    "square_word": r"\[\s*(?i:insert|enter|your|fill in|name of|date of|to be|tbd|tba|tbc)\b[^\[\]]{0,60}\]",
    "square_noun": r"\[\s*(?i:(?:(?:the|full|legal|county|court|case|docket|judge|party|agency|village|tribe|tribal|nation|band|last|first) ){0,3}(?:names?|number|date|title|address|amount|tribe|nation|signature|phone|e-?mail))\s*\]",
    "square_tbd": r"\[[^\[\]]{0,60}\b(?:TBD|TBA|TBC|to be (?:filled in|determined|inserted|completed|supplied))\s*\]",
    "square_capitals": r"\[\s*[A-Z]{2,}(?:[ _-][A-Z0-9]{2,}){0,6}\s*\]",
    "square_line": r"\[\s*(?:_{2,}|\.{3,}|x{3,}|X{2,}|\?{2,})\s*\]",
    "round_pending": r"\(\s*[A-Za-z][A-Za-z _-]{0,50} to be (?:filled in|determined|inserted|completed|supplied|added)\s*\)",
    "line": r"_{4,}",
    "dots": r"\.{8,}\s*\([a-z][a-z _-]{1,50}\)",
    "date": r"\bXX[/.-]XX[/.-](?:XXXX|20XX|19XX|(?:19|20)?__|XX)|\b(?:MM[/.-]DD|DD[/.-]MM)[/.-]YYYY\b",
    "amount": r"\$\s*(?:X{2,}|_{2,})|\bX{2,}(?:,X{3})*\s+(?:[a-z]+\s+)?(?:days|dollars|members|hours|weeks|months|years|percent|persons|feet|acres|miles|copies|votes|minutes|judges)\b",
}
_PLACEHOLDER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PLACEHOLDERS.items()))

# Words in square brackets and capitals that editors put into real text.
EDITORIAL = {"RESERVED", "REPEALED", "SIC", "AMENDED", "OMITTED", "DELETED", "VACANT", "EXPIRED", "RENUMBERED", "SUPERSEDED", "RESCINDED", "SEAL", "SIGNED", "NOTE", "HISTORY", "STATE"}

_CODE = re.compile(r"```.*?```|<code\b.*?</code>|<pre\b.*?</pre>", re.S | re.I)
_TEACHES = re.compile(r"(?i)\b(?:placeholders?|template (?:language|engine|syntax)|syntax|tutorial|for example|e\.g\.|such as|is written|is replaced (?:by|with)|stands for|in braces|between braces|variable named)\b")

#: Placeholders a hundred words from which on an explanation no longer excuses them.
DENSE = 3.0

# Filler words, and words of the usual Latin filler.
FILLER = {"foo", "bar", "baz", "qux", "blah", "test", "abc", "xxx", "tbd", "asdf", "qwerty", "dummy", "lorem", "ipsum", "text", "item", "todo", "yyy", "zzz"}
LATIN = re.compile(r"(?i)\blorem ipsum\b|\bdolor sit amet\b|\bconsectetur adipisc|\bsed do eiusmod\b")
_FILLER_SAYS = re.compile(
    r"(?i)\bthis is (?:a )?(?:placeholder|dummy|sample|filler) (?:content|text|copy|page)\b|\bdummy text (?:for|of)\b|\b(?:your|add|insert|put) (?:\w+ ){0,2}(?:text|content|copy) (?:goes )?here\b"
    r"|\breplace (?:this )?(?:copy|text|content)\b.{0,30}\bbefore (?:the |this )?(?:site|page|document|code) (?:goes live|is published|launches|is posted)\b|\bsample (?:paragraph|text|content) \d|\bplaceholder (?:content|text) \d|\b(?:layout|template|typesetting|print) test\b"
)
_THRICE = re.compile(r"\b([A-Za-z]{2,})(?:\s+\1){2,}\b", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_TOKEN = re.compile(r"[A-Za-z0-9]+")

#: What error pages and notices say, and the traces that only a server leaves.
SAYS = (
    r"enable (?:java ?script|js|cookies|scripts|scripting)", r"(?:java ?script|scripting|scripts|cookies) (?:is|are|must be|has been|have been) (?:switched off|disabled|turned off|required|enabled|blocked|off)",
    r"requires (?:js|java ?script|cookies|scripting)\b", r"turn on (?:scripting|scripts|java ?script|cookies)", r"works only with (?:cookies|scripts|java ?script|active scripts)",
    r"your browser (?:is|does|has|must)\b", r"checking your browser", r"in a modern browser", r"noscript\s*:", r"loading viewer", r"active scripts\b",
    r"verify (?:that )?you are (?:a )?human", r"complete the (?:check|captcha)", r"\bray id\b", r"too many requests", r"before asking \S+ for",
    r"\b(?:page|file|url|document|address|link)\b.{0,80}\bwas not found on\b", r"\b40[0-9]\b[ \-–—:|(]{1,3}(?:error|not found|forbidden|unauthori[sz]ed|bad request|gone)", r"\b50[0-9]\b[ \-–—:|(]{1,3}(?:error|internal server error|service unavailable|bad gateway|gateway time-?out)",
    r"(?:error|http|status) (?:code )?(?:40[0-9]|50[0-9])\b", r"page you (?:asked|are looking|requested|were looking)\b.{0,80}(?:moved|no longer exists|not found|removed|could not|cannot|does not)",
    r"gateway time-?out", r"bad gateway", r"service (?:temporarily )?unavailable\s*[:.\-]", r"internal server error", r"\bdown for maintenance\b", r"access denied\b", r"(?:permission|allowed|authori[sz]ed) to (?:view|access|open) \S+ on this server",
    r"requested url\b.{0,80}was (?:rejected|not found|blocked)", r"support id is", r"consult your administrator", r"tell the webmaster", r"contact the (?:webmaster|site administrator|server administrator)",
    r"error establishing a (?:connection|database)", r"traceback \(most recent call last\)", r"\b(?:key|value|type|attribute|index|runtime)error:", r"warning: \w+\(\)", r"fatal: query", r"fatal error:", r"stack trace:", r"uncaught exception",
    r"session (?:on \S+ |[0-9a-f]+ )?(?:has )?(?:expired|timed out)", r"your session (?:has|on)\b", r"token [0-9a-f]+ is no longer valid", r"log ?in (?:again |to \S+ )?to (?:continue|read|view|see|proceed)", r"please (?:log|sign) ?in\b", r"sign in to (?:continue|read|view|see|your)",
    r"certificate of \S+ is not trusted", r"could not be displayed", r"(?:file|document) \S+ is damaged", r"(?:that|this) link is broken", r"something went wrong", r"\boops!", r"server closed the connection", r"connection (?:was )?(?:reset|refused|timed out)",
    r"(?:rest|remainder) of (?:this|the) (?:section|page|document|text) (?:failed to load|is hidden|could not be loaded|was not loaded)", r"content (?:is )?(?:unavailable|not available|could not be loaded)\b", r"retry \(?\d", r"please try again later", r"then reload\b", r"press reload", r"switch(?:ed)? (?:them|it) on, then",
)
_SAYS = re.compile("|".join(f"(?:{s})" for s in SAYS), re.I)

#: A server's address or path with the numbers that only generated pages have.
_ADDRESS, _NUMBERED = r"\b(?:[a-z0-9-]+\.)+(?:example|com|org|net|gov|edu|info|invalid|test|local)\b(?:/\S*)?", r"(?<![\w/])/[a-z]{2,}\d+/[a-z]+\d+"
_TRACE = re.compile(f"(?i){_ADDRESS}|{_NUMBERED}")
_TECHNICAL = re.compile(r"(?i)\b(?:browser|java ?script|cookies?|scripts?|server|page|error|reload|retry|timeout|timed out|session|log ?in|cache|url|loaded|load|build|support id|reference|maintenance|host|path|site|viewer|incident|code|unavailable|closed|hidden)\b")

# What meets in an error page or notice: words of the technique, failures, requests to the reader, and what only a server writes.
_STRUCTURE = {
    "technique": r"\b(?:java ?script|cookies|browsers?|(?<!process )servers?|webmaster|web ?site|site map|captcha|https?|urls?|cache|cdn|proxy|upstream|hostname|dns|ssl|firewall|gateway|database|stack trace|web ?page|log ?in page|home page)\b",
    "failure": r"\b(?:failed|fails|unable to|could not|cannot|can't|couldn't|did not|doesn't|not found|does not exist|no longer (?:exists|available|valid)|unavailable|expired|timed out|denied|forbidden|refused|rejected|blocked|disabled|switched off|turned off|not supported|not trusted|not loaded|moved|went wrong|offline|down for|broken|damaged|interrupted|hidden|nowhere|exceeded|out of date|error)\b",
    "request": r"(?:^|\bplease |[,;] then |\bor )(?:enable|turn (?:it |them )?on|switch (?:it |them )?on|allow|reload|refresh|retry|try (?:again|later|another)|log ?in|sign ?in|go back|return to the (?:home|start|previous)|click|check (?:the|that) (?:address|url|link)|check your|clear your|update your|upgrade|contact|search|press|wait \d|verify|disable your|proceed|use the site map)\b",
    "trace": rf"{_ADDRESS}|{_NUMBERED}|(?<![\w$§.,-])(?<!page )(?<!section )(?<!chapter )(?<!rule )(?<!title )[45]0\d\b(?! of\b)(?![-.]\d)|\b(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{{7,}}\b|\b(?:error|ref(?:erence)?|incident|support|ray|request) (?:code|id|number)\W{{0,3}}[0-9a-f]*\d",
}
_PARTS = {k: re.compile(f"(?i){v}") for k, v in _STRUCTURE.items()}
_SENTENCE = re.compile(r"(?<=[.!?:\]])\s+")
_COMMANDS = re.compile(r"(?i)\b(?:shall|may not|whoever|hereby|offen[cs]e|is (?:guilty|liable|entitled|prohibited)|under (?:section|chapter|this)|(?:court|clerk|judge|council|party|person|defendant|officer) (?:may|must|is|has))\b")

# Rough shares of letters and marks in text, by which the rarest literal is chosen.
_SHARE = dict(zip(" etaoinsrhldcumfpgwybvkxjqz", (.18, .1, .08, .07, .06, .06, .06, .05, .05, .05, .03, .03, .02, .02, .02, .02, .02, .02, .02, .02, .01, .008, .006, .0015, .001, .001, .001))) | dict.fromkeys(".,-", .01) | dict.fromkeys("0123456789()$", .005)


def required(grammar: str) -> set[str]:
    """Lower-cased literals of which every match of the grammar, lower-cased, holds at least one; the rarest such set. Empty if there is none."""
    sets: list[set[str]] = []

    def add(x: set[str]) -> None:
        if x and "" not in x:
            sets.append(x)

    def walk(seq, run: set[str]) -> set[str]:
        """The literals that end the sequence, after those in ``run``; every set passed on the way goes to ``sets``."""
        for op, v in seq:
            step: set[str] | None = None
            if op is C.LITERAL:
                step = {chr(v).lower()}
            elif op is C.IN and len(v) <= 12 and all(k is C.LITERAL or k is C.RANGE and x[1] - x[0] < 10 for k, x in v):
                step = {chr(c).lower() for k, x in v for c in ([x] if k is C.LITERAL else range(x[0], x[1] + 1))}
            elif op is C.SUBPATTERN:
                run = walk(v[3], run)
                continue
            elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
                continue
            elif op is C.BRANCH:
                parts = [finite(x) for x in v[1]]
                if None in parts:
                    parts = [required_of(x) for x in v[1]]
                    add(run)
                    add(set().union(*parts) if all(parts) else set())
                    run = {""}
                    continue
                step = set().union(*parts)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, body = v
                once = finite(body)
                if once is not None and (least, most) == (0, 1):
                    step = once | {""}
                elif least:
                    if least != most:  # more may stand before the last ones
                        add(run)
                        run = {""}
                    for _ in range(least):
                        run = walk(body, run)
                    continue
            if step is None or len(run) * len(step) > 256:
                add(run)
                run = {""}
            if step is not None:
                run = {a + b for a in run for b in step}
        return run

    def finite(seq) -> set[str] | None:
        nonlocal sets
        kept, sets = sets, []
        got = walk(seq, {""})
        broke, sets = bool(sets) or any(op in (C.ANY, C.NOT_LITERAL, C.GROUPREF, C.MAX_REPEAT, C.MIN_REPEAT, C.IN, C.SUBPATTERN, C.BRANCH) for op, _ in seq), kept
        return None if broke else got

    def required_of(seq) -> set[str]:
        nonlocal sets
        kept, sets = sets, []
        add(walk(seq, {""}))
        cost = lambda x: sum(math.prod(_SHARE.get(c, 1e-6) for c in w) for w in x)
        best, sets = min(sets, key=cost, default=set()), kept
        return best

    return required_of(P.parse(grammar, re.I))


#: The grammars behind each kind. What has no required literal, capitals in brackets, numbered paths and repeated or resting-hand filler, has its own test.
_GRAMMARS = {"placeholder": tuple(v for k, v in PLACEHOLDERS.items() if k != "square_capitals"), "filler": (LATIN.pattern, _FILLER_SAYS.pattern), "error_page": (*SAYS, _ADDRESS)}
_CAPITAL_BRACKET = re.compile(r"\[\s*[A-Z]{2,}[A-Z0-9 _-]*\]")
_PATH = re.compile(f"(?i){_NUMBERED}")
_HOME_ROW = "asdfghjklqwerzxcv"
# Letters that match an ASCII letter where case is set aside, but are no such letter in lower case.
_FOLD = str.maketrans({"ſ": "s", "ı": "i", "\u0307": None})


def _placeholders(text: str) -> str | None:
    body = _CODE.sub(" ", text)
    found = [m for m in _PLACEHOLDER.finditer(body) if not (m.lastgroup == "square_capitals" and any(w in EDITORIAL for w in re.findall(r"[A-Z]+", m.group())))]
    if not found:
        return None
    words = len(_WORD.findall(body)) or 1
    if 100 * len(found) / words >= DENSE:
        return "placeholder"
    for m in found:
        lo = max(body.rfind(". ", 0, m.start()), body.rfind("\n\n", 0, m.start())) + 1
        hi = body.find(". ", m.end())
        if not _TEACHES.search(body[lo : hi if hi >= 0 else len(body)]):
            return "placeholder"
    return None


def _may_repeat(flat: str, low: str, filler_words: int) -> bool:
    """Whether the tests of ``_filler`` on repeated words, on the share of filler words or on the letters may hold; quick, and never false where one holds."""
    words = low.split(" ")
    if any(map(and_, map(str.endswith, words, words[1:]), map(str.startswith, words[2:], words[1:]))):
        return True
    plain = [w for w in flat.split(" ") if w.isascii() and w.isalpha()]  # some of the words that are counted
    return 2 * filler_words >= len(plain) or sum(map("".join(plain).lower().count, "tino")) <= 0.03 * len(low)


def _filler(text: str, flat: str) -> str | None:
    if LATIN.search(flat) or _FILLER_SAYS.search(flat) or _THRICE.search(flat):
        return "filler"
    words = [w.lower() for w in _TOKEN.findall(text)]
    letters = [w for w in words if w.isalpha()]
    if len(letters) >= 4 and sum(w in FILLER for w in letters) >= 0.5 * len(letters):
        return "filler"
    joined = "".join(letters)
    # Hands resting on a keyboard: hardly any letter of the upper right or lower right.
    if len(letters) >= 4 and len(joined) >= 20 and sum(map(joined.count, _HOME_ROW)) >= 0.97 * len(joined):
        return "filler"
    return None


def _page(flat: str) -> str | None:
    if _SAYS.search(flat):
        return "error_page"
    for m in _TRACE.finditer(flat):
        if _TECHNICAL.search(flat[max(0, m.start() - 120) : m.end() + 120]):
            return "error_page"
    return None


def _structure(flat: str) -> str | None:
    """Whether two successive sentences, none of which commands, hold three of the four parts of a notice, a technical word among them."""
    if not _PARTS["technique"].search(flat):
        return None
    sentences = _SENTENCE.split(flat)
    technical = [i for i, s in enumerate(sentences) if _PARTS["technique"].search(s)]
    held: dict[int, set[str]] = {}
    for i in {k for j in technical for k in (j - 1, j, j + 1) if 0 <= k < len(sentences)}:
        held[i] = set() if _COMMANDS.search(sentences[i]) else {k for k, part in _PARTS.items() if part.search(sentences[i])}
    for i, here in held.items():
        both = here | held.get(i - 1, set())
        if "technique" in both and len(both) >= 3 and ("trace" in both or "request" in here):
            return "error_page"
    return None


class Detector:
    """Tells which residue a text holds; null and blank texts hold none."""

    def __init__(self):
        import ahocorasick

        triggers: dict[str, set[str]] = {}
        for kind, grammars in _GRAMMARS.items():
            for g in grammars:
                for t in required(g):
                    triggers.setdefault(t, set()).add(kind)
        for t in FILLER:
            triggers.setdefault(t, set()).add("filler_word")
        for t in required(_STRUCTURE["technique"]):
            triggers.setdefault(t, set()).add("technique")
        self._any = ahocorasick.Automaton()
        for t, kinds in triggers.items():
            self._any.add_word(t, kinds)
        self._any.make_automaton()

    def __call__(self, text: str | None) -> list[str]:
        if not text or text.isspace():
            return []
        flat = " ".join(text.split())
        low = flat.lower() if flat.isascii() else flat.lower().translate(_FOLD)
        hits = [kinds for _, kinds in self._any.iter(low)]
        look = set().union(*hits)
        code = "```" in text or "<code" in low or "<pre" in low
        if code or "[" in flat and _CAPITAL_BRACKET.search(flat):
            look.add("placeholder")
        if "/" in flat and _PATH.search(flat):
            look.add("error_page")
        out = [_placeholders(text if code else flat)] if "placeholder" in look else []
        out += [_filler(text, flat)] if "filler" in look or _may_repeat(flat, low, sum("filler_word" in kinds for kinds in hits)) else []
        page = _page(flat) if "error_page" in look else None
        out.append(page or (_structure(flat) if "technique" in look else None))
        return [k for k in out if k]


def detect(df: DataFrame, key: str = "provision_id", text: str = "text") -> DataFrame:
    """(key, residue): one row for each row of ``df`` whose text holds residue, with the kinds found.

    Null and blank texts and null keys have no row; repeated rows stay repeated; whole texts are read; extra
    columns are ignored; an empty table gives an empty table. There is no shuffle.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector()
        for b in batches:
            found = [detector(t) for t in b.column(1).to_pylist()]
            keep = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.list_(pa.string()))], [key, "residue"])

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.col(text))
    return rows.mapInArrow(run, f"`{key}` {kind}, residue array<string>")


def exclude(df: DataFrame, key: str = "provision_id", text: str = "text") -> DataFrame:
    """``df`` without the rows whose text holds residue."""
    return df.join(detect(df, key, text).select(key).distinct(), key, "left_anti")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provisions that hold template residue, filler, an error page or a notice."""
    return detect(table(spark, sf_dir, "corpus")).select("provision_id").distinct()


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many provisions hold each kind of residue."""
    found = detect(table(spark, sf_dir, "corpus")).select("provision_id", F.explode("residue").alias("kind")).distinct()
    return found.groupBy("kind").agg(F.count("*").alias("n_provisions"))
