"""License scans by ordered signature rules.

Hundreds of hand-written regexes over the words of a text (joined by single blanks), each
gated by a keyword that must occur before its regex runs, behind one gate for the whole
text, which is derived from the regexes and looks at the joined words. A detection is an interval of the text with the rule's priority. It is
suppressed if its interval is contained in that of another detection of higher priority,
or of the same priority and greater length, or equal to that of an earlier rule; what is
left gives the labels. The base phrases are found apart and never suppressed.

Words: A-Z lower-cased, runs of letters a-z, digits and everything outside ASCII. Null
text: no words. Repeated detections of a label count once. Empty table: no rows.
"""

from __future__ import annotations

from re import _parser

from pyspark.sql import DataFrame, functions as F

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Signature rules: label; priority (higher wins); keyword; regexes, split at " ;; ". Fixed values, written by hand.
SIGNATURES = r"""
mit; 90; mit; under the mit license ;; licensed under mit ;; mit license ;; spdx license identifier mit\b
mit; 95; permission is hereby; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)? to deal in the software without restriction
mit-0; 96; mit 0; spdx license identifier mit 0 ;; mit no attribution ;; mit 0 license
x11; 80; x11; x11 license ;; spdx license identifier x11
expat; 70; expat; expat license ;; licensed under the expat
apache-2; 90; apache; apache license( version)? 2( 0)? ;; apache 2 0 license ;; apache software license( version)? 2( 0)? ;; spdx license identifier apache 2 0 ;; licensed under( the)? apache 2 ;; apache org licenses license 2 0
apache-1.1; 90; apache; apache( software)? license( version)? 1 1 ;; spdx license identifier apache 1 1
apache-1.0; 90; apache; apache( software)? license( version)? 1 0 ;; spdx license identifier apache 1 0
apache; 50; apache; apache( software)? license ;; licensed under( the)? apache
gpl-3; 90; gpl; gpl ?v?3 ;; gnu gpl( version)? 3 ;; spdx license identifier gpl 3 0( only| or later)?
gpl-3; 92; general public license; gnu general public license( as published by the free software foundation)?( either)?( version| v) ?3 ;; general public license v ?3
gpl-2; 90; gpl; gpl ?v?2 ;; gnu gpl( version)? 2 ;; spdx license identifier gpl 2 0( only| or later)?
gpl-2; 92; general public license; gnu general public license( as published by the free software foundation)?( either)?( version| v) ?2 ;; general public license v ?2
gpl-1; 90; general public license; gnu general public license( version| v) ?1\b ;; spdx license identifier gpl 1 0( only| or later)?
gpl; 50; gpl; gnu gpl ;; licensed under( the)? gpl ;; gpl license
gpl; 52; general public license; gnu general public license ;; the general public license
lgpl-3; 94; lesser general public; gnu lesser general public license( version| v) ?3
lgpl-2.1; 94; lesser general public; gnu lesser general public license( version| v) ?2 1
lgpl-2; 94; library general public; gnu library general public license( version| v) ?2
lgpl-3; 93; lgpl; lgpl ?v?3 ;; spdx license identifier lgpl 3 0( only| or later)?
lgpl-2.1; 93; lgpl; lgpl ?v?2 1 ;; spdx license identifier lgpl 2 1( only| or later)?
lgpl-2; 92; lgpl; lgpl ?v?2 0 ;; spdx license identifier lgpl 2 0( only| or later)?
lgpl; 55; lesser general public; gnu lesser general public license
lgpl; 54; lgpl; gnu lgpl ;; licensed under( the)? lgpl
agpl-3; 95; affero; gnu affero general public license( version| v) ?3 ;; affero general public license v ?3
agpl-3; 94; agpl; agpl ?v?3 ;; spdx license identifier agpl 3 0( only| or later)?
agpl; 56; affero; gnu affero general public license ;; affero general public license
gfdl-1.3; 93; documentation license; gnu free documentation license( version)? 1 3
gfdl-1.2; 93; documentation license; gnu free documentation license( version)? 1 2
gfdl-1.1; 93; documentation license; gnu free documentation license( version)? 1 1
gfdl; 55; documentation license; gnu free documentation license ;; free documentation license
bsd-2; 90; bsd; bsd 2 clause ;; 2 clause bsd ;; two clause bsd ;; simplified bsd license ;; freebsd license ;; spdx license identifier bsd 2 clause
bsd-3; 90; bsd; bsd 3 clause ;; 3 clause bsd ;; three clause bsd ;; new bsd license ;; modified bsd license ;; spdx license identifier bsd 3 clause
bsd-4; 90; bsd; bsd 4 clause ;; 4 clause bsd ;; four clause bsd ;; original bsd license ;; spdx license identifier bsd 4 clause
bsd-0; 90; bsd; bsd zero clause ;; zero clause bsd ;; 0bsd ;; spdx license identifier 0bsd
bsd; 50; bsd; bsd license ;; bsd style license ;; licensed under( the)? bsd
bsd-3; 88; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd-3; 89; neither the name; neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4; 89; advertising materials; all advertising materials mentioning features or use of this software must display
isc; 90; isc; isc license ;; spdx license identifier isc\b ;; internet systems consortium license
isc; 88; permission to use; permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted
mpl-2; 90; mozilla; mozilla public license( version| v)? ?2( 0)?
mpl-1.1; 90; mozilla; mozilla public license( version| v)? ?1 1
mpl-1.0; 90; mozilla; mozilla public license( version| v)? ?1 0
mpl; 50; mozilla; mozilla public license
mpl-2; 88; mpl; spdx license identifier mpl 2 0 ;; mpl ?v?2 0
mpl-1.1; 88; mpl; spdx license identifier mpl 1 1 ;; mpl ?v?1 1
epl-2; 90; eclipse; eclipse public license( version| v)? ?2( 0)?
epl-1; 90; eclipse; eclipse public license( version| v)? ?1( 0)?
epl; 50; eclipse; eclipse public license
epl-2; 88; epl; spdx license identifier epl 2 0 ;; epl ?v?2 0
epl-1; 88; epl; spdx license identifier epl 1 0 ;; epl ?v?1 0
edl-1; 90; eclipse distribution; eclipse distribution license( version| v)? ?1( 0)?
cddl-1.0; 90; common development; common development and distribution license( version)? 1 0
cddl-1.1; 90; common development; common development and distribution license( version)? 1 1
cddl; 50; common development; common development and distribution license
cddl; 48; cddl; spdx license identifier cddl 1 [01] ;; licensed under( the)? cddl
cpl-1; 90; common public; common public license( version)?( 1 0)?
cc-by-nc-nd; 97; cc by; cc by nc nd( [1-4] [0-9])? ;; spdx license identifier cc by nc nd
cc-by-nc-sa; 97; cc by; cc by nc sa( [1-4] [0-9])? ;; spdx license identifier cc by nc sa
cc-by-nc; 90; cc by; cc by nc( [1-4] [0-9])? ;; spdx license identifier cc by nc
cc-by-nd; 90; cc by; cc by nd( [1-4] [0-9])? ;; spdx license identifier cc by nd
cc-by-sa; 90; cc by; cc by sa( [1-4] [0-9])? ;; spdx license identifier cc by sa
cc-by; 60; cc by; cc by( [1-4] [0-9])? ;; spdx license identifier cc by
cc-by-nc-nd; 98; creative commons; creative commons attribution non ?commercial no ?deriv(ative|ative work)?s?
cc-by-nc-sa; 98; creative commons; creative commons attribution non ?commercial share ?alike
cc-by-nc; 91; creative commons; creative commons attribution non ?commercial
cc-by-nd; 91; creative commons; creative commons attribution no ?deriv(ative|ative work)?s?
cc-by-sa; 91; creative commons; creative commons attribution share ?alike
cc-by; 61; creative commons; creative commons attribution
cc0; 92; cc0; cc0( 1 0)?( universal)? ;; spdx license identifier cc0 1 0
cc0; 91; creative commons; creative commons zero ;; creative commons public domain dedication
cc; 30; creative commons; creative commons( license| licence) ;; licensed under( a)? creative commons
pddl; 90; public domain; public domain dedication and license ;; open data commons public domain
public-domain; 60; public domain; dedicated to the public domain ;; released into the public domain ;; (is|are) in the public domain
odbl; 90; open database; open database license ;; odbl 1 0
odc-by; 90; open data commons; open data commons attribution license ;; odc by 1 0
unlicense; 92; unlicense; the unlicense ;; spdx license identifier unlicense ;; unlicense org
unlicense; 90; unencumbered; this is free and unencumbered software released into the public domain
wtfpl; 92; wtfpl; wtfpl ;; spdx license identifier wtfpl
wtfpl; 90; do what the; do what the f\w* you want to public license
beerware; 90; beerware; beerware license ;; the beerware ;; spdx license identifier beerware
zlib; 90; zlib; zlib license ;; zlib libpng license ;; spdx license identifier zlib
zlib; 85; provided as is; this software is provided as is without any express or implied warranty in no event will the authors
libpng; 90; libpng; libpng license ;; spdx license identifier libpng
bsl-1.0; 92; boost; boost software license( version)?( 1 0)? ;; spdx license identifier bsl 1 0
busl-1.1; 92; business source; business source license( version)?( 1 1)?
sspl-1; 92; server side public; server side public license( version)?( 1)? ;; sspl v?1
elastic-2; 92; elastic license; elastic license( version)? 2( 0)? ;; elastic license v2
ncsa; 90; ncsa; university of illinois ncsa open source license ;; spdx license identifier ncsa
python-2; 90; python; python software foundation license( version)? 2 ;; psf license ;; psf 2 0
python; 60; python; python software foundation license ;; python license
artistic-2; 90; artistic; artistic license( version)? 2( 0)? ;; spdx license identifier artistic 2 0
artistic-1; 90; artistic; artistic license( version)? 1( 0)? ;; spdx license identifier artistic 1 0
artistic; 50; artistic; artistic license ;; perl artistic
perl; 70; perl; same terms as perl itself
ruby; 80; ruby; ruby license ;; same terms as ruby
php-3; 90; php license; php license( version)? 3( 01?)?
php; 50; php license; php license
vim; 80; vim; vim license ;; spdx license identifier vim
w3c; 90; w3c; w3c software( notice and)?( document)? license ;; spdx license identifier w3c
ofl-1.1; 92; open font; sil open font license( version)?( 1 1)? ;; open font license
ofl-1.1; 90; ofl; spdx license identifier ofl 1 1
upl-1.0; 92; universal permissive; universal permissive license( v| version)? ?1 0 ;; universal permissive license
ms-pl; 90; microsoft; microsoft public license ;; ms pl license
ms-rl; 90; microsoft; microsoft reciprocal license ;; ms rl license
eupl-1.2; 92; european union public; european union public licen[cs]e( version| v)? ?1 2
eupl-1.1; 92; european union public; european union public licen[cs]e( version| v)? ?1 1
eupl; 60; european union public; european union public licen[cs]e
cecill-2.1; 92; cecill; cecill( free software license agreement)?( version)? 2 1 ;; spdx license identifier cecill 2 1
cecill; 60; cecill; cecill( free software)? license ;; licence cecill
osl-3; 90; open software license; open software license( version| v)? ?3 0
osl-2.1; 90; open software license; open software license( version| v)? ?2 1
osl; 50; open software license; open software license
afl-3; 90; academic free; academic free license( version| v)? ?3 0
afl-2.1; 90; academic free; academic free license( version| v)? ?2 1
afl; 50; academic free; academic free license
postgresql; 90; postgresql; postgresql licen[cs]e ;; spdx license identifier postgresql
openssl; 90; openssl; openssl license ;; spdx license identifier openssl
curl; 85; curl; curl license ;; spdx license identifier curl
icu; 85; icu; icu license ;; spdx license identifier icu
unicode; 85; unicode; unicode license( agreement)? ;; unicode inc license agreement ;; spdx license identifier unicode
zpl-2.1; 90; zope; zope public license( version)?( 2 1)?
qpl-1; 90; q public; q public license( version)?( 1 0)?
sleepycat; 85; sleepycat; sleepycat license ;; sleepycat public license
apsl-2; 90; apple public; apple public source license( version)?( 2 0)?
npl-1.1; 90; netscape; netscape public license( version)?( 1 1)?
ipl-1; 90; ibm public; ibm public license( version)?( 1 0)?
lppl-1.3; 90; latex project; latex project public license( version)?( 1 3c?)?
rpl-1.5; 90; reciprocal public; reciprocal public license( version)?( 1 5)?
nposl-3; 90; non profit open; non profit open software license( version)?( 3 0)?
mulan-2; 90; mulan; mulan psl v?2 ;; mulan permissive software license( v| version)? ?2
blueoak-1; 90; blue oak; blue oak model license( version)?( 1 0 0)?
parity-7; 85; parity; parity public license( version)?( 7 0 0)?
polyform; 85; polyform; polyform (noncommercial|small business|shield|strict|perimeter)( license)?( 1 0 0)?
commons-clause; 85; commons clause; commons clause( license)?( condition)?( v1 0)?
openrail; 85; rail; (open|bigscience) ?rail( m)?( license)? ;; responsible ai license
llama; 80; llama; llama [0-9]( [0-9])? community license( agreement)?
proprietary; 40; all rights; all rights reserved
proprietary; 45; proprietary; proprietary and confidential ;; proprietary license ;; this software is proprietary
copyright; 10; copyright; copyright( c)? [12][0-9]{3} ;; copyright( c)? by ;; copyright notice
spdx; 20; spdx; spdx license identifier [a-z0-9]+
generic; 5; licen; licen[cs]ed under ;; this work is licen[cs]ed ;; see( the)? licen[cs]e( file)? ;; subject to the terms of( the)? [a-z0-9 ]{1,40}? licen[cs]e ;; distributed under( the)? [a-z0-9 ]{1,40}? licen[cs]e
no-warranty; 6; warrant; without (any )?warrant(y|ies) of any kind ;; without even the implied warranty of ;; as is without warrant(y|ies)
"""


def needed(regex: str) -> str:
    """The longest run of characters that every match of ``regex`` holds."""
    runs = [""]
    for op, arg in _parser.parse(regex):
        if str(op) == "LITERAL":
            runs[-1] += chr(arg)
        elif str(op) != "AT":  # whatever has a width and may differ ends a run
            runs.append("")
    return max(runs, key=len)


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, regex) in order; regexes begin and end at word bounds and take in a leading grant.

    The keyword is the one of the line where the regex cannot match without it, else the longest run it needs.
    """
    out = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, keyword, regexes = line.split("; ", 3)
        out += [(label, int(priority), keyword if keyword in needed(x) else needed(x), rf"\b(?:(?:this work is )?licen[cs]ed under (?:the |a |an )?)?(?:{x})\b") for x in regexes.split(" ;; ")]
    return out


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def gate(norm: str) -> str:
    """SQL of whether the joined words hold what some rule needs, or a base phrase."""
    words = {needed(x) for line in SIGNATURES.strip().splitlines() for x in line.split("; ", 3)[3].split(" ;; ")} | {p for p, _ in BASE}
    least = sorted(w for w in words if not any(v in w and v != w for v in words))
    return "(" + " OR ".join(f"contains({norm}, {quoted(w)})" for w in least) + ")"


def phrase_places(norm: str, phrase: str) -> str:
    """SQL of (n, first, last): how often a phrase stands in the joined words, and its smallest and largest start."""
    k = phrase.count(" ") + 1
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    cut = f"split({norm}, ' {phrase}(?= )', -1)"
    body = (
        f"named_struct('n', CAST(size(c) - 1 AS BIGINT), 'first', CAST({blanks('c[0]')} AS BIGINT), "
        f"'last', CAST({blanks(norm)} - {blanks('element_at(c, -1)')} - {k} AS BIGINT))"
    )
    none = "named_struct('n', 0L, 'first', CAST(NULL AS BIGINT), 'last', CAST(NULL AS BIGINT))"
    return f"CASE WHEN contains({norm}, ' {phrase} ') THEN transform(array({cut}), c -> {body})[0] ELSE {none} END"


def detections(norm: str) -> str:
    """SQL of the array of (start, end, priority, rule, label) of all signature matches in the joined words."""
    table = ", ".join(f"named_struct('label', {quoted(a)}, 'priority', {b}, 'keyword', {quoted(c)}, 'regex', {quoted(d)}, 'rule', {i})" for i, (a, b, c, d) in enumerate(rules()))
    kind = "array<struct<start:int,end:int,priority:int,rule:int,label:string>>"
    here = "s.at + length(element_at(m.gap, i))"
    stop = f"{here} + length(element_at(m.hit, i))"
    fold = (
        f"aggregate(sequence(1, size(m.hit)), named_struct('at', 0, 'out', CAST(array() AS {kind})), (s, i) -> named_struct('at', {stop}, "
        f"'out', concat(s.out, array(named_struct('start', {here}, 'end', {stop}, 'priority', r.priority, 'rule', r.rule, 'label', r.label)))), s -> s.out)"
    )
    found = f"named_struct('gap', split({norm}, r.regex, -1), 'hit', regexp_extract_all({norm}, r.regex, 0))"
    return f"flatten(transform(filter(array({table}), r -> contains({norm}, r.keyword) AND {norm} RLIKE r.regex), r -> transform(array({found}), m -> {fold})[0]))"


def surviving(found: str) -> str:
    """SQL of the detections that no other one contains and outranks."""
    longer = "(y.end - y.start) > (x.end - x.start)"
    outranks = f"(y.priority > x.priority OR y.priority = x.priority AND ({longer} OR y.start = x.start AND y.end = x.end AND y.rule < x.rule))"
    return f"filter({found}, x -> NOT exists({found}, y -> y.start <= x.start AND y.end >= x.end AND {outranks}))"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, word count, base phrases, labels, the surviving detections and a score, for each row of ``docs``.

    Score: the greatest priority of a surviving detection over 100; at least 0.9 with a base phrase; 0 without labels.
    """
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    slim = docs.select("doc_id", "text").select(
        "doc_id",
        F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("n_words"),
        F.concat(F.lit(" "), F.trim(F.regexp_replace(folded, GAPS, " ")), F.lit(" ")).alias("norm"),
    ).withColumn("norm", F.expr(f"get(filter(array(norm), n -> {gate('n')}), 0)"))
    norm = "coalesce(norm, '')"
    placed = slim.select("doc_id", "n_words", "norm", *[F.expr(phrase_places(norm, p)).alias(f"p{i}") for i, (p, _) in enumerate(BASE)])
    kind = "array<struct<start:int,end:int,priority:int,rule:int,label:string>>"
    seen = placed.withColumn("found", F.expr(f"CASE WHEN norm IS NULL THEN CAST(array() AS {kind}) ELSE {detections('norm')} END"))
    seen = seen.withColumn("kept", F.when(F.size("found") > 0, F.expr(surviving("found"))).otherwise(F.col("found")))
    base = F.array_compact(F.array(*[F.when(F.col(f"p{i}.n") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]))
    priority = F.coalesce(F.array_max(F.transform("kept", lambda x: x["priority"])), F.lit(0)) / 100.0
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return seen.select(
        "doc_id", "n_words",
        sum((F.col(f"p{i}.n") for i in range(1, len(BASE))), F.col("p0.n")).alias("n_base"),
        F.least(*[F.col(f"p{i}.first") for i in range(len(BASE))]).alias("first_word"),
        F.greatest(*[F.col(f"p{i}.last") for i in range(len(BASE))]).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("kept", lambda x: x["label"]))).alias("labels"),
        F.greatest(priority, F.when(F.size(base) > 0, F.lit(0.9)).otherwise(F.lit(0.0))).alias("score"),
        F.col("kept").alias("detections"),
    )
