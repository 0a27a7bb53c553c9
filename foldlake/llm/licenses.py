"""Licence scan with ordered signature rules.

Texts are read as words. A rule is a regular expression over the words joined by spaces, with a priority, a confidence
and the keywords without which it cannot match. Only texts that hold a gate word are looked at, and in them only rules
whose keywords occur. Detections are intervals of words; one that lies inside another of higher priority, or of equal
priority and greater length, is suppressed. Base phrases are reported at every place and never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# ---------------------------------------------------------------- rules

#: Phrases that are always reported, by label.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

_L = "licen[sc]es?"
_V = "(?: version| v)?"

#: Licences without versions of their own: label, name, short form, address (words of a URL), keywords.
_PLAIN = [
    ("mit", rf"mit {_L}|massachusetts institute of technology {_L}|expat {_L}", "mit|expat", f"opensource org {_L} mit", "mit|expat|massachusetts"),
    ("mit-0", rf"mit no attribution(?: {_L})?", "mit 0", "github com aws mit 0", "mit"),
    ("isc", rf"isc {_L}|internet systems consortium {_L}", "isc", f"opensource org {_L} isc", "isc|consortium"),
    ("0bsd", rf"zero clause bsd {_L}|bsd zero clause {_L}", "0bsd", f"opensource org {_L} 0bsd", "bsd|0bsd"),
    ("bsd-2-clause", rf"(?:2|two) clause bsd {_L}|simplified bsd {_L}|freebsd {_L}|bsd 2 clause {_L}", "bsd 2 clause", f"opensource org {_L} bsd 2 clause", "bsd"),
    ("bsd-3-clause", rf"(?:3|three) clause bsd {_L}|new bsd {_L}|modified bsd {_L}|bsd 3 clause {_L}", "bsd 3 clause", f"opensource org {_L} bsd 3 clause", "bsd"),
    ("bsd-4-clause", rf"(?:4|four) clause bsd {_L}|original bsd {_L}|bsd 4 clause {_L}", "bsd 4 clause", "spdx org licenses bsd 4 clause", "bsd"),
    ("bsd", rf"bsd(?: style)? {_L}|berkeley software distribution {_L}", "bsd", f"opensource org {_L} bsd", "bsd|berkeley"),
    ("zlib", rf"zlib(?: libpng)? {_L}", "zlib", f"opensource org {_L} zlib", "zlib"),
    ("libpng", rf"libpng {_L}", "libpng(?: 2 0)?", "libpng org pub png src libpng license", "libpng"),
    ("unlicense", r"the unlicense|this is free and unencumbered software released into the public domain", "unlicense", "unlicense org", "unlicense|unencumbered"),
    ("wtfpl", rf"do what the fuck you want to public {_L}|wtfpl", "wtfpl", "wtfpl net", "wtfpl|fuck"),
    ("beerware", rf"beer ?ware {_L}|the beer ware {_L}", "beerware", "people freebsd org phk", "beer|beerware"),
    ("postgresql", rf"postgresql {_L}", "postgresql", f"opensource org {_L} postgresql", "postgresql"),
    ("php", rf"php {_L}{_V}(?: \d+)*", "php 3 0(?: 1)?", "php net license", "php"),
    ("python", rf"python software foundation {_L}|psf {_L}|python {_L}", "psf 2 0|python 2 0", "docs python org license", "python|psf"),
    ("ruby", rf"ruby(?: s)? {_L}", "ruby", "ruby lang org en about license", "ruby"),
    ("perl", rf"same terms as perl itself|perl {_L}", "artistic 1 0 perl", "dev perl org licenses", "perl"),
    ("openssl", rf"openssl {_L}|openssl project", "openssl", "openssl org source license", "openssl"),
    ("curl", rf"curl {_L}", "curl", "curl se docs copyright", "curl"),
    ("x11", rf"x11 {_L}|x consortium {_L}", "x11", "spdx org licenses x11", "x11|consortium"),
    ("ntp", rf"ntp {_L}|network time protocol {_L}", "ntp", f"opensource org {_L} ntp", "ntp|protocol"),
    ("ncsa", rf"(?:university of illinois )?ncsa(?: open source)? {_L}", "ncsa", f"opensource org {_L} ncsa", "ncsa"),
    ("icu", rf"icu {_L}", "icu", "unicode org icu license", "icu"),
    ("unicode", rf"unicode(?: data files and software)? {_L}", r"unicode(?: dfs)?(?: \d+)*", "unicode org copyright", "unicode"),
    ("w3c", rf"w3c(?: software(?: notice and)?)?(?: document)? {_L}", "w3c", "w3 org consortium legal", "w3c|w3"),
    ("ofl", rf"sil open font {_L}(?:{_V} 1 1)?|open font {_L}", "ofl 1 1", "scripts sil org ofl", "font|ofl"),
    ("ms-pl", rf"microsoft public {_L}", "ms pl", f"opensource org {_L} ms pl", "microsoft|ms pl"),
    ("ms-rl", rf"microsoft reciprocal {_L}", "ms rl", f"opensource org {_L} ms rl", "microsoft|ms rl"),
    ("cc0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v?1 0)?(?: universal)?", "cc0 1 0", "creativecommons org publicdomain zero", "cc0|zero"),
    ("cc-pdm", r"public domain mark(?: 1 0)?", "cc pdm 1 0", "creativecommons org publicdomain mark", "mark|pdm"),
    ("odbl", rf"open database {_L}|odc open database {_L}", "odbl 1 0", "opendatacommons org licenses odbl", "database|odbl"),
    ("odc-by", rf"open data commons attribution {_L}", "odc by 1 0", "opendatacommons org licenses by", "commons|odc"),
    ("pddl", rf"public domain dedication and {_L}", "pddl 1 0", "opendatacommons org licenses pddl", "dedication|pddl"),
    ("ogl-uk", rf"open government {_L}(?:{_V} \d(?: 0)?)?", "ogl uk \\d 0", "nationalarchives gov uk doc open government licence", "government|ogl"),
    ("etalab", r"licence ouverte(?: open licence)?(?: (?:version )?\d 0)?", "etalab 2 0", "etalab gouv fr licence ouverte", "ouverte|etalab"),
    ("dl-de-by", r"datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?", "dl de by 2 0", "govdata de dl de by", "datenlizenz|govdata|dl de"),
    ("openrail", rf"open ?rail(?: m)? {_L}|responsible ai {_L}", "openrail(?: m)?", "huggingface co spaces bigscience license", "openrail|rail|responsible"),
    ("sspl", rf"server side public {_L}(?:{_V} 1)?", "sspl 1 0", "mongodb com licensing server side public license", "server side|sspl"),
    ("busl", rf"business source {_L}(?:{_V} 1 1)?", "busl 1 1|bsl 1 1", "mariadb com bsl11", "business|busl|bsl"),
    ("elastic", rf"elastic {_L}(?: 2 0)?", "elastic 2 0", "elastic co licensing elastic license", "elastic"),
    ("commons-clause", r"commons clause", "commons clause", "commonsclause com", "clause|commonsclause"),
    ("blueoak", rf"blue oak model {_L}(?: 1 0 0)?", "blueoak 1 0 0", "blueoakcouncil org license", "oak|blueoak"),
    ("upl", rf"universal permissive {_L}", "upl 1 0", "oss oracle com licenses upl", "universal|upl"),
    ("vim", rf"vim {_L}", "vim", "vimdoc sourceforge net htmldoc uganda", "vim"),
    ("fair", rf"fair {_L}", "fair", f"opensource org {_L} fair", "fair"),
    ("sleepycat", rf"sleepycat {_L}", "sleepycat", f"opensource org {_L} sleepycat", "sleepycat"),
    ("cecill-b", rf"cecill b(?: {_L})?", "cecill b", "cecill info licences licence cecill b", "cecill"),
    ("cecill-c", rf"cecill c(?: {_L})?", "cecill c", "cecill info licences licence cecill c", "cecill"),
    ("mulan", rf"mulan permissive software {_L}", "mulanpsl 2 0", f"{_L} coscl org cn mulanpsl2", "mulan|mulanpsl"),
    ("eupl", rf"european union public {_L}(?:{_V} 1 [12])?", "eupl 1 [12]", "joinup ec europa eu collection eupl", "european|eupl"),
]

#: Licences with versions: label, name, short form, address, versions, keywords. {v} is the version in words.
_VERSIONED = [
    ("gpl", rf"(?:gnu )?general public {_L}{_V} {{v}}|gnu gpl{_V} ?{{v}}", "gpl ?v? ?{{v}}(?: or later| only)?", "gnu org licenses(?: old licenses)? gpl {{v}}", ("1", "2", "3"), "general public|gpl|gplv1|gplv2|gplv3|gpl1|gpl2|gpl3"),
    ("lgpl", rf"(?:gnu )?(?:lesser|library) general public {_L}{_V} {{v}}", "lgpl ?v? ?{{v}}(?: or later| only)?", "gnu org licenses(?: old licenses)? lgpl {{v}}", ("2", "2.1", "3"), "lesser|library|lgpl|lgplv2|lgplv3|lgpl2|lgpl3"),
    ("agpl", rf"(?:gnu )?affero general public {_L}{_V} {{v}}", "agpl ?v? ?{{v}}(?: or later| only)?", "gnu org licenses agpl {{v}}", ("1", "3"), "affero|agpl|agplv1|agplv3|agpl1|agpl3"),
    ("gfdl", rf"(?:gnu )?free documentation {_L}{_V} {{v}}", "gfdl {{v}}(?: or later| only)?", "gnu org licenses fdl {{v}}", ("1.1", "1.2", "1.3"), "documentation|gfdl|fdl"),
    ("apache", rf"apache(?: software)? {_L}{_V} {{v}}", "apache {{v}}", "apache org licenses license {{v}}", ("1.0", "1.1", "2.0"), "apache"),
    ("mpl", rf"mozilla public {_L}{_V} {{v}}", "mpl {{v}}", "mozilla org (?:en us )?mpl {{v}}", ("1.0", "1.1", "2.0"), "mozilla|mpl"),
    ("epl", rf"eclipse public {_L}{_V} {{v}}", "epl {{v}}", "eclipse org legal epl(?: v)? ?{{v}}", ("1.0", "2.0"), "eclipse|epl"),
    ("cddl", rf"common development and distribution {_L}{_V} {{v}}", "cddl {{v}}", f"opensource org {_L} cddl {{{{v}}}}", ("1.0", "1.1"), "development|cddl"),
    ("artistic", rf"artistic {_L}{_V} {{v}}", "artistic {{v}}", "perlfoundation org artistic license {{v}}", ("1.0", "2.0"), "artistic"),
    ("afl", rf"academic free {_L}{_V} {{v}}", "afl {{v}}", f"opensource org {_L} afl {{{{v}}}}", ("1.1", "2.1", "3.0"), "academic|afl"),
    ("osl", rf"open software {_L}{_V} {{v}}", "osl {{v}}", f"opensource org {_L} osl {{{{v}}}}", ("1.0", "2.1", "3.0"), "open software|osl"),
    ("bsl", rf"boost software {_L}{_V} {{v}}", "bsl {{v}}", "boost org license {{v}}", ("1.0",), "boost|bsl"),
    ("zpl", rf"zope public {_L}{_V} {{v}}", "zpl {{v}}", "zope org zpl {{v}}", ("1.1", "2.0", "2.1"), "zope|zpl"),
    ("lppl", rf"latex project public {_L}{_V} {{v}}", "lppl {{v}}", "latex project org lppl {{v}}", ("1.2", "1.3", "1.3c"), "latex|lppl"),
    ("cecill", rf"cecill (?:{_L})?{_V} ?{{v}}", "cecill {{v}}", "cecill info licences licence cecill v{{v}}", ("1.0", "2.0", "2.1"), "cecill"),
    ("llama", rf"llama {{v}} community {_L}(?: agreement)?", "llama{{v}}", "ai meta com llama license {{v}}", ("2", "3", "3.1"), "llama|llama2|llama3"),
]

#: Creative Commons elements by their words in a name.
_COMMONS = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative|atives|s)(?: works)?",
    "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative|atives|s)(?: works)?",
}
_COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0", "")

#: Notices that name no licence: label, signature, keyword.
_NOTICES = [
    ("reserved", "all rights (?:are )?reserved", "reserved"),
    ("reserved", "tous droits reserves|tous droits réservés", "droits"),
    ("reserved", "alle rechte vorbehalten", "rechte"),
    ("reserved", "todos los derechos reservados", "derechos"),
    ("some-reserved", "some rights reserved", "reserved"),
    ("public-domain", "(?:dedicated to|released into|placed in|in) the public domain", "public domain"),
    ("public-domain", "no rights reserved", "reserved"),
    ("copyright", r"copyright (?:c )?(?:by )?(?:19|20)\d\d", "copyright"),
    ("copyright", r"(?:19|20)\d\d copyright", "copyright"),
    ("copyright", "copyright(?:ed)? (?:material|works?|notice|holders?|owners?)", "copyright|copyrighted"),
    ("proprietary", "proprietary and confidential|confidential and proprietary", "proprietary"),
    ("proprietary", "unauthorized (?:copying|reproduction|distribution|use)", "unauthorized"),
    ("proprietary", f"commercial {_L} agreement|end user {_L} agreement", "agreement"),
    ("proprietary", "may not be (?:reproduced|copied|redistributed|used)", "not be"),
    ("no-redistribution", "not for redistribution|do not redistribute|redistribution is prohibited", "redistribution|redistribute"),
    ("non-commercial", "for non ?commercial (?:use|purposes)(?: only)?", "commercial|noncommercial"),
    ("research-only", "for research (?:use|purposes) only", "research"),
    ("with-permission", "(?:used|reprinted|reproduced) (?:with|by) permission", "permission"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose", "permission to use"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "binary forms"),
    ("disclaimer", "(?:is|are) provided as is without(?: any)? warrant(?:y|ies)", "as is"),
    ("disclaimer", "without warranty of any kind", "warranty"),
    ("terms-of-use", "subject to (?:the )?terms (?:of (?:use|service)|and conditions)", "subject to"),
    ("patent", "patents? pending|protected by (?:one or more )?patents?", "patent|patents"),
    ("trademark", "(?:registered )?trademarks? of", "trademark|trademarks"),
    ("unnamed-license", rf"(?:released|licensed|distributed|published) under (?:the|an?) [^ ]+(?: [^ ]+){{0,3}} {_L}", "license|licence|licenses|licences"),
]

_GRANT = (r"(?:licensed|licenced|released|distributed|available|published|provided|offered|shared|redistribute it and or modify it)"
          r"(?: to you)? under(?: the)?(?: (?:terms|conditions) of)?(?: the)?(?: (?:gnu))? ")


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]  # words or phrases, one of which every match contains
    priority: int
    confidence: float


def _rule(label: str, signature: str, keywords: str, priority: int, confidence: float) -> Rule:
    return Rule(label, re.compile(rf"(?<![^ ])(?:{signature})(?![^ ])"), tuple(keywords.split("|")), priority, confidence)


def _family(label: str, name: str, short: str, address: str, keywords: str) -> Iterator[Rule]:
    """A machine-readable tag, a grant, an address and the bare name of one licence, in this order of priority."""
    yield _rule(label, f"spdx {_L} identifier (?:{short})", "spdx", 50, 1.0)
    yield _rule(label, f"{_GRANT}(?:{name}|(?:{short})(?: {_L})?)", keywords, 40, 0.95)
    yield _rule(label, address, max(re.findall(r"[a-z0-9]+", address), key=len), 30, 0.9)
    yield _rule(label, name, keywords, 20, 0.8)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    found: list[Rule] = []
    for label, name, short, address, keywords in _PLAIN:
        found += _family(label, name, short, address, keywords)
    for label, name, short, address, versions, keywords in _VERSIONED:
        for version in versions:
            words = version.replace(".", " ") if "." in version else f"{version}(?: 0)?"
            fill = lambda s: s.replace("{{v}}", words).replace("{v}", words)  # noqa: B023, E731
            found += _family(f"{label}-{version}", fill(name), fill(short), fill(address), keywords)
        bare = name.split(_V)[0]
        if "{v}" not in bare:
            found.append(_rule(label, bare, keywords, 15, 0.7))
    for kind, words in _COMMONS.items():
        for version in _COMMONS_VERSIONS:
            number = f" {version.replace('.', ' ')}" if version else ""
            label = f"cc-{kind}" + (f"-{version}" if version else "")
            name = f"creative commons {words}{number}(?: (?:international|unported|generic))?(?: {_L})?|cc {kind.replace('-', ' ')}{number}"
            address = f"creativecommons org licenses {kind.replace('-', ' ')}{number}"
            found += [Rule(r.label, r.pattern, r.keywords, r.priority + len(kind) // 3 + bool(version), r.confidence)
                      for r in _family(label, name, f"cc {kind.replace('-', ' ')}{number}", address, "cc|creative|creativecommons")]
    for label, signature, keyword in _NOTICES:
        found.append(_rule(label, signature, keyword, 10, 0.6))
    return tuple(sorted(found, key=lambda r: -r.priority))


@lru_cache(maxsize=1)
def gate() -> tuple[frozenset[bytes], dict[bytes, tuple[tuple[bytes, tuple[Rule, ...]], ...]]]:
    """The prefilter: words to look for, and by word the keyword phrases it stands for, each with its rules.

    A phrase is found by its longest word. Base phrases are among them, without rules.
    """
    by_phrase: dict[str, list[Rule]] = {phrase: [] for phrase in BASE.values()}
    for rule in rules():
        for keyword in rule.keywords:
            by_phrase.setdefault(keyword, []).append(rule)
    by_word: dict[bytes, list] = {}
    for phrase, of in by_phrase.items():
        by_word.setdefault(max(phrase.split(), key=len).encode(), []).append((f" {phrase} ".encode(), tuple(of)))
    return frozenset(by_word), {word: tuple(found) for word, found in by_word.items()}


# ---------------------------------------------------------------- scan

#: Bytes that belong to words stay, all others become spaces.
_TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass(frozen=True)
class Detection:
    label: str
    first: int  # words, last included
    last: int
    priority: int
    confidence: float


def detect(line: str, candidates: list[Rule]) -> tuple[list[Detection], list[Detection]]:
    """Base detections, and kept detections of the candidate rules, in words joined by spaces."""
    starts = [0, *(m.end() for m in re.finditer(" ", line))]

    def interval(match: re.Match) -> tuple[int, int]:
        return bisect_right(starts, match.start()) - 1, bisect_right(starts, match.end() - 1) - 1

    base = [Detection(label, *interval(m), 0, 0.5) for label, phrase in BASE.items() if phrase in line
            for m in re.finditer(rf"(?<![^ ]){phrase}(?![^ ])", line)]
    found = [Detection(r.label, *interval(m), r.priority, r.confidence) for r in candidates for m in r.pattern.finditer(line)]
    found.sort(key=lambda d: (-d.priority, d.first - d.last, d.first, d.label))
    return base, _uncontained(found)


def _uncontained(found: list[Detection]) -> list[Detection]:
    """Those not inside an earlier one. ``firsts`` and ``lasts`` outline what is covered: both rise."""
    firsts: list[int] = []
    lasts: list[int] = []
    kept: list[Detection] = []
    for d in found:
        k = bisect_right(firsts, d.first)
        if k and lasts[k - 1] >= d.last:
            continue
        kept.append(d)
        end = bisect_right(lasts, d.last, lo=k)
        start = k - 1 if k and firsts[k - 1] == d.first else k
        firsts[start:end], lasts[start:end] = [d.first], [d.last]
    return kept


def scan_text(text: bytes) -> tuple[int, list[Detection], list[Detection]]:
    """Words, base detections and rule detections of one whole UTF-8 text."""
    words = text.lower().translate(_TO_WORDS).split()  # bytes: only A-Z are lower-cased
    gate_words, phrases = gate()
    seen = gate_words.intersection(words)
    if not seen:
        return len(words), [], []
    line = b" ".join([b"", *words, b""])
    found = [of for word in seen for phrase, of in phrases[word] if phrase in line]
    if not found:
        return len(words), [], []
    return len(words), *detect(line[1:-1].decode(), list(dict.fromkeys(r for of in found for r in of)))


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    A null text is empty: no words, no labels ("") and score 0. The score is the largest confidence of a detection.
    ``detections`` are the kept ones, base first, as label, first and last word, priority and confidence. Null and
    repeated doc_ids are rows like any other; an empty table gives no rows; other columns are not read.
    """
    fields = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
              "detections array<struct<label: string, first_word: bigint, last_word: bigint, priority: int, confidence: double>>")
    kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("priority", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                n, base, found = scan_text(text or b"")
                every = [*base, *found]
                places = [d.first for d in base]
                rows.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted({d.label for d in base})),
                             ",".join(sorted({d.label for d in every})), max((d.confidence for d in every), default=0.0),
                             [{"label": d.label, "first_word": d.first, "last_word": d.last, "priority": d.priority, "confidence": d.confidence} for d in every]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            columns = zip(*rows) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, kinds)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(run, fields)
