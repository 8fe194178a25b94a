"""License scan by ordered signature rules, in JVM-side SQL only.

A text is first held against the keywords of all rules; texts without one have no detection. For the
rest, a rule is tried only if its keyword occurs (keyword prefilter). Keywords are single words, so
white space within a match does not hide them. Detections of all rules are then
resolved by priority and containment: one that lies inside a detection of the same or a higher
priority is dropped. Every text is scanned whole and by itself, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower

#: label | keywords (single words), one of which each match holds | name as a regex over lower-cased text (a blank stands for
#: any white space) | SPDX ids
NAMES = r"""
apache-1.1 | apache | apache (software )?licen[cs]e,? ?(version |v)?1\.1 | apache-1\.1
apache-2.0 | apache | apache (software )?(licen[cs]e)?,? ?(version |v)?2(\.0)?( licen[cs]e)? | apache-2\.0
apache | apache | apache (software )?licen[cs]e | apache
mit | mit/expat/x11 | (mit|expat|x11)(-style)? licen[cs]e | mit
mit-0 | mit | mit(-0| no attribution)( licen[cs]e)? | mit-0
isc | isc | isc licen[cs]e | isc
0bsd | bsd/clause | (0bsd|(bsd )?zero[- ]clause( bsd)?)( licen[cs]e)? | 0bsd
bsd-2-clause | bsd/clause | ((bsd[- ]2|2|two)[- ]clause( bsd)?|simplified bsd|freebsd)( licen[cs]e)? | bsd-2-clause
bsd-3-clause | bsd/clause | ((bsd[- ]3|3|three)[- ]clause( bsd)?|(new|modified|revised) bsd)( licen[cs]e)? | bsd-3-clause
bsd-4-clause | bsd/clause | ((bsd[- ]4|4|four)[- ]clause( bsd)?|original bsd)( licen[cs]e)? | bsd-4-clause
bsd | bsd | bsd(-style)? licen[cs]e | bsd
gpl-1.0 | gpl/general | (gnu )?(gpl|general public licen[cs]e)s?,? ?(version |v|-)?1(\.0)?(?!\.?[0-9]) | gpl-1\.0(-only|-or-later)?\+?
gpl-2.0 | gpl/general | (gnu )?(gpl|general public licen[cs]e)s?,? ?(version |v|-)?2(\.0)?(?!\.?[0-9]) | gpl-2\.0(-only|-or-later)?\+?
gpl-3.0 | gpl/general | (gnu )?(gpl|general public licen[cs]e)s?,? ?(version |v|-)?3(\.0)?(?!\.?[0-9]) | gpl-3\.0(-only|-or-later)?\+?
gpl | gpl/general | (gnu )?(gpl|general public licen[cs]e) | gpl
lgpl-2.0 | lgpl/general | (gnu )?(lgpl|(lesser|library) general public licen[cs]e),? ?(version |v|-)?2(\.0)?(?!\.?[0-9]) | lgpl-2\.0(-only|-or-later)?\+?
lgpl-2.1 | lgpl/general | (gnu )?(lgpl|(lesser|library) general public licen[cs]e),? ?(version |v|-)?2\.1 | lgpl-2\.1(-only|-or-later)?\+?
lgpl-3.0 | lgpl/general | (gnu )?(lgpl|(lesser|library) general public licen[cs]e),? ?(version |v|-)?3(\.0)?(?!\.?[0-9]) | lgpl-3\.0(-only|-or-later)?\+?
lgpl | lgpl/general | (gnu )?(lgpl|(lesser|library) general public licen[cs]e) | lgpl
agpl-3.0 | agpl/affero | (gnu )?(agpl|affero general public licen[cs]e),? ?(version |v|-)?3(\.0)? | agpl-3\.0(-only|-or-later)?\+?
agpl | agpl/affero | (gnu )?(agpl|affero general public licen[cs]e) | agpl
gfdl | documentation | (gnu )?free documentation licen[cs]e,? ?((version |v)?[0-9.]+)? | gfdl-1\.[1-3](-only|-or-later)?
mpl-1.1 | mpl/mozilla | (mozilla public licen[cs]e|mpl),? ?(version |v|-)?1\.1 | mpl-1\.1
mpl-2.0 | mpl/mozilla | (mozilla public licen[cs]e|mpl),? ?(version |v|-)?2(\.0)? | mpl-2\.0
mpl | mozilla | mozilla public licen[cs]e | mpl
epl-1.0 | eclipse | eclipse public licen[cs]e,? ?(-|version |v)*1(\.0)? | epl-1\.0
epl-2.0 | eclipse | eclipse public licen[cs]e,? ?(-|version |v)*2(\.0)? | epl-2\.0
epl | eclipse | eclipse (public|distribution) licen[cs]e | epl
cddl-1.0 | cddl/distribution | (common development and distribution licen[cs]e|cddl),? ?(version |v|-)?1\.0 | cddl-1\.0
cddl | distribution | common development and distribution licen[cs]e | cddl
eupl-1.1 | eupl/european | (european union public licen[cs]e|eupl),? ?(version |v\.? ?|-)?1\.1 | eupl-1\.1
eupl-1.2 | eupl/european | (european union public licen[cs]e|eupl),? ?(version |v\.? ?|-)?1\.2 | eupl-1\.2
eupl | european | european union public licen[cs]e | eupl
artistic-1.0 | artistic | artistic licen[cs]e,? ?(version |v)?1(\.0)? | artistic-1\.0
artistic-2.0 | artistic | artistic licen[cs]e,? ?(version |v)?2(\.0)? | artistic-2\.0
artistic | artistic | artistic licen[cs]e | artistic
bsl-1.0 | boost | boost software licen[cs]e,? ?(-|version |v)*(1\.0)? | bsl-1\.0
busl-1.1 | business | business source licen[cs]e,? ?(version |v)?(1\.1)? | busl-1\.1
zlib | zlib | zlib(/libpng)? licen[cs]e | zlib
libpng | png | (lib)?png licen[cs]e | libpng(-2\.0)?
openssl | openssl | openssl licen[cs]e | openssl
php | php | php licen[cs]e,? ?((version |v)?3\.0[01]?)? | php-3\.0[01]?
python | python/psf | (python software foundation|psf|python) licen[cs]e,? ?((version |v)?2)? | (python|psf)-2\.0
ruby | ruby | ruby licen[cs]e | ruby
perl | perl | same terms as perl( itself)? | perl
postgresql | postgresql | postgresql licen[cs]e | postgresql
ncsa | ncsa | (university of illinois/)?ncsa( open source)? licen[cs]e | ncsa
unlicense | unlicense | (the )?unlicense | unlicense
wtfpl | wtfpl/public | (do what the f[a-z*]+ you want to public licen[cs]e|wtfpl) | wtfpl
cc0-1.0 | cc0 | (creative commons )?cc0( 1\.0)?( universal)? | cc0-1\.0
cc-by | cc/creative | (creative commons attribution|cc[- ]by)(?![- ](nc|nd|sa|non|no[- ]d|share))([- ](international|unported))?( licen[cs]e)? | cc-by
cc-by-1.0 | cc | cc[- ]by[- ]1\.0 | cc-by-1\.0
cc-by-2.0 | cc | cc[- ]by[- ]2\.0 | cc-by-2\.0
cc-by-2.5 | cc | cc[- ]by[- ]2\.5 | cc-by-2\.5
cc-by-3.0 | cc | cc[- ]by[- ]3\.0 | cc-by-3\.0
cc-by-4.0 | cc | cc[- ]by[- ]4\.0 | cc-by-4\.0
cc-by-sa | cc | cc[- ]by[- ]sa | cc-by-sa
cc-by-sa-2.0 | cc | cc[- ]by[- ]sa[- ]2\.0 | cc-by-sa-2\.0
cc-by-sa-3.0 | cc | cc[- ]by[- ]sa[- ]3\.0 | cc-by-sa-3\.0
cc-by-sa-4.0 | cc | cc[- ]by[- ]sa[- ]4\.0 | cc-by-sa-4\.0
cc-by-nc | cc | cc[- ]by[- ]nc | cc-by-nc
cc-by-nc-2.0 | cc | cc[- ]by[- ]nc[- ]2\.0 | cc-by-nc-2\.0
cc-by-nc-3.0 | cc | cc[- ]by[- ]nc[- ]3\.0 | cc-by-nc-3\.0
cc-by-nc-4.0 | cc | cc[- ]by[- ]nc[- ]4\.0 | cc-by-nc-4\.0
cc-by-nd | cc | cc[- ]by[- ]nd([- ][1-4]\.[05])? | cc-by-nd-[1-4]\.[05]
cc-by-nc-sa | cc | cc[- ]by[- ]nc[- ]sa([- ][1-4]\.[05])? | cc-by-nc-sa-[1-4]\.[05]
cc-by-nc-nd | cc | cc[- ]by[- ]nc[- ]nd([- ][1-4]\.[05])? | cc-by-nc-nd-[1-4]\.[05]
cc-by-sa | creative | creative commons attribution[- ]share[- ]?alike( [1-4]\.[05])?( (international|unported))?( licen[cs]e)? | cc-by-sa
cc-by-nc | creative | creative commons attribution[- ]non[- ]?commercial( [1-4]\.[05])?( (international|unported))?( licen[cs]e)? | cc-by-nc
cc-by-nd | creative | creative commons attribution[- ]no[- ]?deriv(ative)?s?( [1-4]\.[05])?( (international|unported))?( licen[cs]e)? | cc-by-nd
cc | creative | creative commons( licen[cs]e)? | cc
odbl | database | (odc )?open database licen[cs]e | odbl-1\.0
odc-by | attribution | (odc|open data commons)[- ]?attribution licen[cs]e | odc-by-1\.0
pddl | pddl/public | (public domain dedication and licen[cs]e|pddl) | pddl-1\.0
ofl-1.1 | font | (sil )?open font licen[cs]e,? ?((version |v)?1\.1)? | ofl-1\.1
ms-pl | microsoft | microsoft public licen[cs]e | ms-pl
ms-rl | microsoft | microsoft reciprocal licen[cs]e | ms-rl
cpl-1.0 | common | common public licen[cs]e,? ?((version |v)?1\.0)? | cpl-1\.0
ipl-1.0 | ibm | ibm public licen[cs]e,? ?((version |v)?1\.0)? | ipl-1\.0
afl-3.0 | academic | academic free licen[cs]e,? ?((version |v)?3\.0)? | afl-3\.0
osl-3.0 | software | open software licen[cs]e,? ?((version |v)?3\.0)? | osl-3\.0
sspl-1.0 | server | server side public licen[cs]e | sspl-1\.0
elastic-2.0 | elastic | elastic licen[cs]e,? ?((version |v)?2(\.0)?)? | elastic-2\.0
openrail | rail | (open)?rail(-m|\+\+-m)? licen[cs]e | openrail(-m)?
llama | llama | llama [0-9.]* ?community licen[cs]e( agreement)? | llama[0-9.]*
"""

#: label | keyword (a single word that each match holds) | regex: notices and other wordings that are no license's name
NOTICES = r"""
all-rights-reserved | reserved | all rights reserved
some-rights-reserved | reserved | some rights reserved
no-rights-reserved | reserved | no rights reserved
copyright | copyright | copyright (\(c\)|©)? ?[12][0-9]{3}
public-domain | public | (released|placed|dedicated|put)( in)?(to)? the public domain
public-domain | public | (is|are) in the public domain
proprietary | proprietary | (proprietary and confidential|proprietary licen[cs]e)
proprietary | confidential | confidential and proprietary
no-redistribution | redistribut | (may not be|no|not for|without) (reproduced or )?redistribut(ion|ed)
no-reproduction | permission | (without|except with) (the )?(prior |express )*(written )?permission
mit | permission | permission is hereby granted, free of charge, to any person obtaining a copy
isc | permission | permission to use, copy, modify,? and(/or)? distribute this software for any purpose
bsd | redistribut | redistribution and use in source and binary forms, with or without modification
bsd-3-clause | endorse | neither the name of .{1,80} nor the names of its contributors may be used to endorse
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
apache-2.0 | applicable | unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e
apache-2.0 | apache | (https?://)?(www\.)?apache\.org/licenses/license-2\.0
gpl | redistribut | free software: you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
gpl | gnu | (https?://)?(www\.)?gnu\.org/licenses/gpl
lgpl | gnu | (https?://)?(www\.)?gnu\.org/licenses/lgpl
agpl | gnu | (https?://)?(www\.)?gnu\.org/licenses/agpl
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[cs]e
mpl | mozilla | (https?://)?(www\.)?mozilla\.org/(en-us/)?mpl
zlib | warrant | this software is provided 'as-is', without any express or implied warranty
unlicense | encumbered | this is free and unencumbered software released into the public domain
bsl-1.0 | boost | boost\.org/license_1_0
cc-by | creativecommons | creativecommons\.org/licenses/by/[0-9.]+
cc-by-sa | creativecommons | creativecommons\.org/licenses/by-sa/[0-9.]+
cc-by-nc | creativecommons | creativecommons\.org/licenses/by-nc/[0-9.]+
cc-by-nd | creativecommons | creativecommons\.org/licenses/by-nd/[0-9.]+
cc-by-nc-sa | creativecommons | creativecommons\.org/licenses/by-nc-sa/[0-9.]+
cc-by-nc-nd | creativecommons | creativecommons\.org/licenses/by-nc-nd/[0-9.]+
cc0-1.0 | creativecommons | creativecommons\.org/publicdomain/zero
warranty-disclaimer | warrant | without warrant(y|ies) (or conditions )?of any kind
warranty-disclaimer | merchantability | merchantability,? (or|and)? ?fitness for a particular purpose
non-commercial | commercial | (for )?non-?commercial (use|purposes)( only)?
license-reference | licen | (see|refer to)( the)? licen[cs]e(\.txt|\.md| file)
"""

#: Priorities: a detection hides those of the same or a lower one (larger number) that lie inside it.
IDENTIFIER, GRANT, MENTION = 1, 2, 3
CONFIDENCE = {IDENTIFIER: 1.0, GRANT: 0.9, MENTION: 0.6}
BASE_CONFIDENCE = 0.5
#: Base phrases: (words, label).
PHRASES = ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"),
           (("all", "rights", "reserved"), "reserved"))

_GAP = r"[\x20\x09-\x0D]+"
_EDGE = (r"(?<![a-z0-9])", r"(?![a-z0-9])")
_GRANT = (r"(licen[cs]ed|released|distributed|available|published|provided|covered|made available|redistributed|shared)"
          r"( and distributed)? (under|by|with)( the)?( terms of( the)?)?( an?)? ")


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keywords, pattern) in order."""
    named = [[c.strip() for c in line.split(" | ")] for line in NAMES.strip().splitlines()]
    notices = [[c.strip() for c in line.split(" | ")] for line in NOTICES.strip().splitlines()]
    found = [(label, IDENTIFIER, "spdx", rf"spdx-licen[cs]e-identifier: ?({ids})") for label, _, _, ids in named]
    found += [(label, GRANT, key, rf"{_GRANT}({name})") for label, key, name, _ in named]
    found += [(label, GRANT, key, name) for label, key, name in notices]
    found += [(label, MENTION, key, name) for label, key, name, _ in named]
    return [(label, priority, key, _EDGE[0] + "(?:" + pattern.replace(" ?", "[\\x20\\x09-\\x0D]*").replace(" ", _GAP) + ")"
             + _EDGE[1]) for label, priority, key, pattern in found]


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``detections``: array of (label, priority, start, end, rule), code points, end exclusive.

    A null text has an empty array. Detections are in text order and resolved.
    """
    table = rules()
    of_rule = ", ".join(f"struct({k} AS rule, {_quote(label)} AS label, {priority} AS priority, array({', '.join(map(_quote, key.split('/')))}) AS keywords, "
                        f"{_quote(pattern)} AS pattern)" for k, (label, priority, key, pattern) in enumerate(table))
    words = sorted({k for _, _, key, _ in table for k in key.split("/")})
    keys = ", ".join(map(_quote, words))
    roots = [w for w in words if not any(k != w and k in w for k in words)]  # a text without one holds no keyword
    hit = "struct<label:string,priority:int,start:int,end:int,rule:int>"
    df = df.withColumn("_raw", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("_low", F.lower("_raw"))
    # one loop: some hundred tests side by side become one method whose compilation takes up to gigabytes of an executor
    # (_low stands there twice so that it stays a column: inlined, it would be computed anew for every root)
    gate = f"_low <> '' AND exists(array({', '.join(map(_quote, roots))}), r -> contains(_low, r))"
    df = df.withColumn("_low", F.when(F.expr(gate), ascii_lower("_raw")))
    df = df.withColumn("_keys", F.expr(f"CASE WHEN _low IS NOT NULL THEN filter(array({keys}), k -> contains(_low, k)) END"))
    # _keys stands here twice so that it stays a column: inlined, it would be computed anew for every rule
    df = df.withColumn("_hits", F.expr(f"""
        CASE WHEN size(_keys) > 0 THEN flatten(transform(
            filter(array({of_rule}), r -> arrays_overlap(_keys, r.keywords) AND rlike(_low, r.pattern)),
            r -> aggregate(arrays_zip(split(_low, r.pattern, -1), regexp_extract_all(_low, r.pattern, 0)),
                struct(0 AS at, CAST(array() AS array<{hit}>) AS found),
                (a, z) -> struct(
                    a.at + length(z.`0`) + coalesce(length(z.`1`), 0) AS at,
                    CASE WHEN z.`1` IS NULL THEN a.found ELSE array_append(a.found, struct(r.label AS label,
                        r.priority AS priority, a.at + length(z.`0`) AS start,
                        a.at + length(z.`0`) + length(z.`1`) AS end, r.rule AS rule)) END AS found),
                a -> a.found))) END"""))
    # text order, the longer first, then priority and rule order: whatever contains a detection comes before it
    df = df.withColumn("_hits", F.expr(
        "transform(array_sort(transform(_hits, h -> struct(h.start AS s, -h.end AS e, h.priority AS p, h.rule AS r, h AS h))), x -> x.h)"))
    kept = F.expr(f"""
        aggregate(_hits, struct(0 AS m1, 0 AS m2, 0 AS m3, CAST(array() AS array<{hit}>) AS kept),
            (a, h) -> struct(
                CASE WHEN h.priority = 1 THEN greatest(a.m1, h.end) ELSE a.m1 END AS m1,
                CASE WHEN h.priority = 2 THEN greatest(a.m2, h.end) ELSE a.m2 END AS m2,
                CASE WHEN h.priority = 3 THEN greatest(a.m3, h.end) ELSE a.m3 END AS m3,
                CASE WHEN h.end <= a.m1 OR (h.priority >= 2 AND h.end <= a.m2) OR (h.priority = 3 AND h.end <= a.m3)
                     THEN a.kept ELSE array_append(a.kept, h) END AS kept),
            a -> a.kept)""")
    return (df.withColumn("detections", F.coalesce(kept, F.expr(f"CAST(array() AS array<{hit}>)")))
            .drop("_raw", "_low", "_keys", "_hits"))


def phrase_places(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words and, for each base phrase k, its places _n<k>, first and last start _a<k>, _b<k>."""
    sep = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    df = df.withColumn("_words", F.btrim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), sep, "  ")))
    df = df.withColumn("n_words", F.expr(
        "CAST(CASE WHEN _words = '' THEN 0 ELSE (length(_words) - length(replace(_words, '  ', ''))) / 2 + 1 END AS BIGINT)"))
    # each word stands between two blanks of its own, so neighbouring phrases share none
    df = df.withColumn("_words", F.concat(F.lit(" "), F.lower("_words"), F.lit(" ")))
    for k, (words, _) in enumerate(PHRASES):
        p = _quote(" " + "  ".join(words) + " ")
        blanks = "(length({0}) - length(replace({0}, ' ', ''))) / 2"
        there = f"CASE WHEN contains(_words, {p}) THEN CAST({{}} AS BIGINT) END"
        head = blanks.format(f"substring(_words, 1, instr(_words, {p}) - 1)")
        tail = blanks.format(f"substring_index(_words, {p}, -1)")
        df = df.withColumns({
            f"_n{k}": F.expr(there.format(f"(length(_words) - length(replace(_words, {p}, ''))) / length({p})")),
            f"_a{k}": F.expr(there.format(head)),
            f"_b{k}": F.expr(there.format(f"n_words - {len(words)} - {tail}"))})
    return df.drop("_words")


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections per row of ``docs``.

    Takes doc_id and text; a null text has no words and no labels. Repeated rows are scanned one by
    one. score is the confidence of the best detection (identifier 1, grant or notice 0.9, mention
    0.6, a base phrase alone 0.5, nothing 0).
    """
    df = phrase_places(docs.select(F.col("doc_id").cast("long"), "text"))
    df = scan(df)
    some = range(len(PHRASES))
    found = F.array_compact(F.array(*[F.when(F.col(f"_n{k}") > 0, F.lit(PHRASES[k][1])) for k in some]))
    level = " ".join(f"WHEN {p} THEN {c}D" for p, c in CONFIDENCE.items())
    best = F.expr(f"coalesce(array_max(transform(detections, d -> CASE d.priority {level} END)), 0D)")
    df = df.withColumn("_base", F.array_sort(found))
    return df.select(
        "doc_id", "n_words", sum(F.coalesce(f"_n{k}", F.lit(0)) for k in some).cast("long").alias("n_base"),
        F.least(*[f"_a{k}" for k in some]).alias("first_word"), F.greatest(*[f"_b{k}" for k in some]).alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.expr("transform(detections, d -> d.label)")))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("_base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0))).alias("score"),
        "detections")


def op5(spark, sf_dir: str) -> DataFrame:
    return license_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
