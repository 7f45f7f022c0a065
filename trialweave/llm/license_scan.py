"""License scans: ordered signature rules over word-normalised text, without any shuffle.

A text is read once for a cheap gate (a few word stems). Only gated texts are normalised: A-Z lower-cased, every run of
other ASCII becomes one space. A rule has a keyword, a regex over whole words, a priority and a label; its regex runs
only on texts that contain its keyword. All places of all rules become word intervals, and an interval that lies within
one of higher priority, or within a longer one of the same priority, is suppressed. Base phrases have the highest
priority and are never suppressed. Everything is a column expression of one row, so hot sources and repeated texts need
no treatment of their own.

The rules are the product of hand-written license names (keyword and regex) and hand-written statement forms, plus
single rules for statements that name no license. Score: the weight of the highest priority that remains, else 0.

Defined results: null text counts as empty; texts without words have n_words 0 and empty labels; first_word and
last_word are null without a base place; repeated rows get equal results; an empty table stays empty; extra columns
are left out of the query and kept by ``scan``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialweave.llm import query
from trialweave.llm.common import ascii_lower, free_name, table

SEPARATOR_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: label | keyword | regex of the name, in normalised words
NAMES = """
MIT | expat | expat(?: x11)?
MIT | mit | mit(?: x11)?
Apache-1.0 | apache | apache(?: software)?(?: license)?(?: version)? 1 0
Apache-1.1 | apache | apache(?: software)?(?: license)?(?: version)? 1 1
Apache-2.0 | apache | apache(?: software)?(?: license)?(?: version)? (?:v2|2)(?: 0)?
BSD-1-Clause | bsd | (?:1|one) clause bsd|bsd (?:1|one) clause
BSD-2-Clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause
BSD-3-Clause | bsd | (?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause
BSD-4-Clause | bsd | (?:original|old|4 clause|four clause) bsd|bsd (?:4|four) clause
BSD | bsd | bsd(?: style)?
0BSD | zero clause | (?:bsd zero clause|zero clause bsd)
0BSD | 0bsd | 0bsd
ISC | isc | isc
Zlib | zlib | zlib(?: libpng)?
Libpng | png reference | png reference library(?: version 2)?
Libpng | libpng | libpng(?: version 2)?
X11 | x11 | x11
NCSA | ncsa | (?:university of illinois )?ncsa(?: open source)?
PostgreSQL | postgresql | postgresql
BSL-1.0 | boost | boost(?: software)?(?: license)?(?: version)?(?: 1 0)?
Unlicense | unlicense | (?:the )?unlicense
WTFPL | wtfpl | wtfpl(?: version)?(?: 2)?
Beerware | beerware | beerware
CC0-1.0 | cc0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)?
GPL-1.0 | general public | gnu general public license (?:version |v)?1
GPL-1.0 | gpl | gpl (?:version |v)?1(?: 0)?
GPL-1.0 | gplv1 | gplv1
GPL-2.0 | general public | gnu general public license (?:version |v)?2
GPL-2.0 | gpl | gpl (?:version |v)?2(?: 0)?
GPL-2.0 | gplv2 | gplv2
GPL-3.0 | general public | gnu general public license (?:version |v)?3
GPL-3.0 | gpl | gpl (?:version |v)?3(?: 0)?
GPL-3.0 | gplv3 | gplv3
GPL | general public | gnu general public license
GPL | gpl | gnu gpl
GPL | gpl | gpl
LGPL-2.0 | general public | gnu (?:library|lesser) general public license (?:version |v)?2(?: 0)?
LGPL-2.0 | lgpl | lgpl (?:version |v)?2(?: 0)?
LGPL-2.1 | general public | gnu lesser general public license (?:version |v)?2 1
LGPL-2.1 | lgpl | lgpl (?:version |v)?2 1
LGPL-3.0 | general public | gnu lesser general public license (?:version |v)?3
LGPL-3.0 | lgpl | lgpl (?:version |v)?3(?: 0)?
LGPL-3.0 | lgplv3 | lgplv3
LGPL | general public | gnu lesser general public license
LGPL | lgpl | gnu lgpl
LGPL | lgpl | lgpl
AGPL-1.0 | affero | affero general public license (?:version |v)?1
AGPL-3.0 | general | gnu affero general public license(?: (?:version |v)?3)?
AGPL-3.0 | agpl | agpl (?:version |v)?3(?: 0)?
AGPL-3.0 | agplv3 | agplv3
GFDL-1.1 | documentation | gnu free documentation license (?:version |v)?1 1
GFDL-1.2 | documentation | gnu free documentation license (?:version |v)?1 2
GFDL-1.3 | documentation | gnu free documentation license (?:version |v)?1 3
GFDL | documentation | gnu free documentation license
MPL-1.0 | mozilla | mozilla public license (?:version |v)?1 0
MPL-1.0 | mpl | mpl 1 0
MPL-1.1 | mozilla | mozilla public license (?:version |v)?1 1
MPL-1.1 | mpl | mpl 1 1
MPL-2.0 | mozilla | mozilla public license (?:version |v)?2(?: 0)?
MPL-2.0 | mpl | mpl 2 0
EPL-1.0 | eclipse | eclipse public license (?:version |v)?1(?: 0)?
EPL-1.0 | epl | epl 1 0
EPL-2.0 | eclipse | eclipse public license (?:version |v)?2(?: 0)?
EPL-2.0 | epl | epl 2 0
EUPL-1.1 | european union | european union public licen[cs]e (?:version |v)?1 1
EUPL-1.1 | eupl | eupl 1 1
EUPL-1.2 | european union | european union public licen[cs]e (?:version |v)?1 2
EUPL-1.2 | eupl | eupl 1 2
CDDL-1.0 | distribution | common development and distribution license(?: (?:version |v)?1 0)?
CDDL-1.0 | cddl | cddl 1 0
CDDL-1.1 | distribution | common development and distribution license (?:version |v)?1 1
CDDL-1.1 | cddl | cddl 1 1
CPL-1.0 | common | common public license(?: (?:version |v)?1 0)?
IPL-1.0 | ibm | ibm public license(?: (?:version |v)?1 0)?
SPL-1.0 | sun | sun public license(?: (?:version |v)?1 0)?
Artistic-1.0 | artistic | artistic(?: license)? (?:version )?1 0
Artistic-2.0 | artistic | artistic(?: license)? (?:version )?2 0
Artistic | artistic | artistic
PHP-3.01 | php | php(?: license)?(?: version)? 3 01
PHP-3.0 | php | php(?: license)?(?: version)? 3 0
PSF-2.0 | python | python software foundation(?: license)?(?: version)?(?: 2)?
PSF-2.0 | psf | psf
Ruby | ruby | ruby
OpenSSL | openssl | openssl(?: ssleay)?
OFL-1.0 | sil | sil open font license (?:version )?1 0
OFL-1.1 | sil | sil open font license(?: (?:version )?1 1)?
AFL-2.1 | academic | academic free license (?:version |v)?2 1
AFL-3.0 | academic | academic free license(?: (?:version |v)?3 0)?
OSL-1.1 | open software | open software license (?:version |v)?1 1
OSL-2.1 | open software | open software license (?:version |v)?2 1
OSL-3.0 | open software | open software license(?: (?:version |v)?3 0)?
MS-PL | microsoft | microsoft public license
MS-PL | ms pl | ms pl
MS-RL | microsoft | microsoft reciprocal license
MS-RL | ms rl | ms rl
MS-LPL | microsoft | microsoft limited public license
NASA-1.3 | nasa | nasa open source agreement(?: (?:version )?1 3)?
Vim | vim | vim
CeCILL-1.0 | cecill | cecill (?:version |v)?1 0
CeCILL-2.1 | cecill | cecill(?: (?:version |v)?2 1)?
CeCILL-B | cecill | cecill b
CeCILL-C | cecill | cecill c
CC-BY-1.0 | cc by | cc by 1 0
CC-BY-1.0 | creative commons | creative commons attribution 1 0(?: generic)?
CC-BY-2.0 | cc by | cc by 2 0
CC-BY-2.0 | creative commons | creative commons attribution 2 0(?: generic)?
CC-BY-3.0 | cc by | cc by 3 0
CC-BY-3.0 | creative commons | creative commons attribution 3 0(?: unported)?
CC-BY-4.0 | cc by | cc by 4 0
CC-BY-4.0 | creative commons | creative commons attribution 4 0(?: international)?
CC-BY | cc by | cc by
CC-BY | creative commons | creative commons attribution
CC-BY-SA-2.0 | cc by | cc by sa 2 0
CC-BY-SA-2.0 | creative commons | creative commons attribution share ?alike 2 0(?: generic)?
CC-BY-SA-3.0 | cc by | cc by sa 3 0
CC-BY-SA-3.0 | creative commons | creative commons attribution share ?alike 3 0(?: unported)?
CC-BY-SA-4.0 | cc by | cc by sa 4 0
CC-BY-SA-4.0 | creative commons | creative commons attribution share ?alike 4 0(?: international)?
CC-BY-SA | cc by | cc by sa
CC-BY-SA | creative commons | creative commons attribution share ?alike
CC-BY-NC-2.0 | cc by | cc by nc 2 0
CC-BY-NC-3.0 | cc by | cc by nc 3 0
CC-BY-NC-4.0 | cc by | cc by nc 4 0
CC-BY-NC-4.0 | creative commons | creative commons attribution non ?commercial 4 0(?: international)?
CC-BY-NC | creative commons | creative commons attribution non ?commercial
CC-BY-NC-SA-4.0 | nc sa | cc by nc sa 4 0
CC-BY-NC-SA | nc sa | cc by nc sa(?: [123] 0)?
CC-BY-NC-ND-4.0 | nc nd | cc by nc nd 4 0
CC-BY-NC-ND | nc nd | cc by nc nd(?: [123] 0)?
CC-BY-ND-4.0 | by nd | cc by nd 4 0
CC-BY-ND | by nd | cc by nd(?: [123] 0)?
ODbL-1.0 | database | open (?:data commons )?(?:open )?database license(?: 1 0)?
ODbL-1.0 | odbl | odbl(?: 1 0)?
ODC-By-1.0 | odc | odc by(?: 1 0)?
PDDL-1.0 | public domain | public domain dedication and license(?: 1 0)?
BUSL-1.1 | business | business source license(?: (?:version )?1 1)?
SSPL-1.0 | server | server side public license(?: (?:version |v)?1)?
Elastic-2.0 | elastic | elastic license(?: (?:version |v)?2(?: 0)?)?
Commons-Clause | commons | commons clause
JSON | json | json
UPL-1.0 | universal | universal permissive license(?: (?:version |v)?1 0)?
BlueOak-1.0.0 | blue | blue oak model(?: license)?(?: 1 0 0)?
MulanPSL-2.0 | mulan | mulan (?:psl|permissive software license)(?: (?:version |v)?2(?: 0)?)?
W3C | w3c | w3c software(?: notice)?(?: and)?
OpenRAIL-M | rail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?
RPL-1.5 | reciprocal | reciprocal public license(?: 1 5)?
QPL-1.0 | q public | q public license(?: (?:version )?1 0)?
LPPL-1.3c | latex | latex project public license(?: (?:version )?1 3c)?
TCL | tcl | tcl tk
ICU | icu | icu
Zend-2.0 | zend | zend(?: engine)?(?: license)?(?: version)?(?: 2 0)?
"""

#: priority | regex with {} for the name
FORMS = """
2 | (?:licensed|released|distributed|published|available|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:{})(?: public)?(?: licen[cs]e)?(?: version \\d+(?: \\d+)?)?
2 | spdx licen[cs]e identifier (?:{})(?: only| or later)?
1 | (?:terms of|subject to) (?:the )?(?:{})(?: licen[cs]e)?
1 | (?:the )?(?:{}) licen[cs]e
"""

#: label | priority | keyword | regex
SINGLE = """
proprietary | 1 | rights reserved | all rights reserved
proprietary | 1 | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | 1 | redistribut | redistribution (?:is|in any form is) (?:strictly )?(?:prohibited|forbidden)
public-domain | 1 | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 0 | public domain | public domain
no-commercial-use | 1 | commercial | (?:not for|no) commercial use
no-commercial-use | 1 | commercial | (?:for )?non ?commercial (?:use|purposes) only
research-only | 1 | research | (?:for )?(?:academic and )?research (?:use|purposes) only
MIT | 1 | permission | permission is hereby granted free of charge to any person obtaining a copy
ISC | 1 | permission | permission to use copy modify and or distribute this software for any purpose
BSD | 1 | redistribution | redistribution and use in source and binary forms
GPL | 1 | free software | this program is free software you can redistribute it and or modify it
AGPL-3.0 | 1 | affero | gnu affero general public license
copyright-notice | 0 | copyright | copyright (?:c )?(?:19|20)\\d\\d
unknown-license | 0 | licen | (?:licensed|released|distributed) under (?:the )?
"""

#: Every rule needs one of these in the lower-cased text; "cc" stands for the one base phrase without such a word.
STEMS = ("licen", "released", "distributed", "published", "available", "provided", "covered", "terms", "subject", "reserved", "domain", "copyright", "confidential", "redistribut", "permission", "commercial", "research", "affero", "free software")
CC = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by"
WEIGHT = {3: 1.0, 2: 0.9, 1: 0.6, 0: 0.3}


def signature_rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, regex) in order; several hundred."""
    cells = lambda text: [[c.strip() for c in line.split(" | ")] for line in text.strip().splitlines()]
    same = {"MIT": "mit", "Apache-2.0": "apache-2", "CC-BY-NC": "cc-by-nc"}  # one label for a licence that the base names too
    rules = [(label, 3, phrase.split()[-1], phrase) for label, phrase in BASE]
    for label, keyword, name in cells(NAMES):
        rules += [(same.get(label, label), int(priority), keyword, form.format(name)) for priority, form in cells(FORMS)]
    return rules + [(same.get(label, label), int(priority), keyword, rx) for label, priority, keyword, rx in cells(SINGLE)]


def normalise(text: Column) -> Column:
    """The words with one space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), SEPARATOR, " ")), F.lit(" "))


def _places(norm: Column, rule: Column) -> Column:
    """All places of a rule as structs (label, priority, low, high), words counted from 0, both ends included."""
    none = F.array().cast("array<struct<label:string,priority:int,low:int,high:int>>")
    marked = F.split(F.trim(F.regexp_replace(norm, rule["mark"], F.lit("\u0001$1"))), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith("\u0001"), i)), lambda i: i.isNotNull())
    spans = lambda hits: F.zip_with(starts, hits, lambda at, hit: F.struct(rule["label"].alias("label"), rule["priority"].alias("priority"), at.alias("low"), (at + F.length(hit) - F.length(F.replace(hit, F.lit(" "), F.lit("")))).alias("high")))
    once = F.array(F.regexp_extract_all(norm, rule["regex"], F.lit(0)))
    return F.get(F.transform(once, lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(none)), 0)


def detections(norm: Column, rules: Sequence[tuple[str, int, str, str]]) -> Column:
    """Array of (label, priority, low, high) of every place of every rule."""
    grouped: dict[str, list] = {}
    for label, priority, keyword, rx in rules:
        grouped.setdefault(keyword, []).append(F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(f"(?<= )(?:{rx})(?= )").alias("regex"), F.lit(f"(?<= )({rx})(?= )").alias("mark")))
    listed = F.array(*[F.struct(F.lit(keyword).alias("keyword"), F.array(*own).alias("rules")) for keyword, own in grouped.items()])
    return F.flatten(F.transform(F.filter(listed, lambda g: F.contains(norm, g["keyword"])), lambda g: F.flatten(F.transform(g["rules"], lambda r: _places(norm, r)))))


def unsuppressed(found: Column, top: int = 3, piece: int = 128) -> Column:
    """Places not contained in one of higher priority nor in a longer one of their own; ``top`` priority always stays.

    Places are taken in order of (low, -high, -priority), so whatever contains a place comes before it. They are swept in
    pieces: a place is held against those before it in its piece, and against the widest reach per priority of all pieces
    before. Work grows with places × ``piece``, not with places².
    """
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)  # noqa: E731  a value used in a lambda is worked out once
    ordered = F.array_sort(F.transform(found, lambda a: F.struct(a["low"].alias("low"), (-a["high"]).alias("left"), (-a["priority"]).alias("below"), a["label"].alias("label"))))
    # per piece and priority: the furthest end, and with it the least start; as negatives, so that the least is the widest
    reach = lambda own, p: F.array_min(F.transform(F.filter(own, lambda a: a["below"] == -p), lambda a: F.struct(a["left"].alias("left"), a["low"].alias("low"))))
    wider = lambda a, b: (b["left"] < a["left"]) | ((b["left"] == a["left"]) & (b["low"] < a["low"]))

    def beaten(a: Column, i: Column, own: Column, far: Column) -> Column:
        near = F.exists(F.slice(own, 1, i), lambda b: (b["left"] <= a["left"]) & ((b["below"] < a["below"]) | ((b["below"] == a["below"]) & wider(a, b))))
        for p in range(top + 1):
            b = far[p]
            near = near | F.coalesce((b["left"] <= a["left"]) & ((F.lit(-p) < a["below"]) | ((F.lit(-p) == a["below"]) & wider(a, b))), F.lit(False))
        return near

    def sweep(pieces: Column) -> Column:
        def kept(reaches: Column) -> Column:
            far = lambda k: F.array(*[F.array_min(F.transform(F.slice(reaches, 1, k), lambda r: r[p])) for p in range(top + 1)])
            one = lambda own, k: let(far(k), lambda f: F.filter(own, lambda a, i: (a["below"] == -top) | ~beaten(a, i, own, f)))
            return F.flatten(F.transform(pieces, one))

        return let(F.transform(pieces, lambda own: F.array(*[reach(own, p) for p in range(top + 1)])), kept)

    cut = lambda rows: F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / piece).cast("int")), lambda k: F.slice(rows, k * piece + 1, F.lit(piece)))
    stay = let(ordered, lambda rows: let(cut(rows), sweep))
    back = F.transform(stay, lambda a: F.struct(a["label"].alias("label"), (-a["below"]).alias("priority"), a["low"].alias("low"), (-a["left"]).alias("high")))
    return F.when(F.size(found) > 1, back).otherwise(found)


def default_gate(low: Column) -> Column:
    gate = F.contains(low, F.lit("cc")) & low.rlike(CC)
    for stem in reversed(STEMS):
        gate = F.contains(low, F.lit(stem)) | gate
    return gate


def count_words(text: Column) -> Column:
    """Number of words: the pieces between separators, less the empty ones at either end."""
    pieces = F.split(text, SEPARATOR_ANY_CASE)
    return (F.size(pieces) - (F.get(pieces, 0) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")).cast("bigint")


def scan(docs: DataFrame, text_col: str = "text", rules: Sequence[tuple[str, int, str, str]] | None = None, gate: Callable[[Column], Column] = default_gate) -> DataFrame:
    """``docs`` plus n_words, found (every place) and kept (places after suppression); columns of these names are replaced.

    ``gate`` must hold (of the lower-cased text) wherever a rule can match.
    """
    norm = free_name(docs, "_norm")
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<label:string,priority:int,low:int,high:int>>")
    gated = docs.withColumn("n_words", count_words(text))
    gated = gated.withColumn(norm, F.when(gate(ascii_lower(text)), normalise(text)))
    gated = gated.withColumn("found", F.when(F.col(norm).isNotNull(), detections(F.col(norm), rules or signature_rules())).otherwise(none)).drop(norm)
    return gated.withColumn("kept", unsuppressed(F.col("found")))


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda p: p["priority"] == 3)
    starts = F.transform(base, lambda p: p["low"].cast("bigint"))
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    highest = F.array_max(F.transform("kept", lambda p: p["priority"]))
    score = F.lit(0.0)
    for priority, weight in WEIGHT.items():
        score = F.when(highest == priority, F.lit(weight)).otherwise(score)
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("kept")).alias("labels"), score.alias("score"))
