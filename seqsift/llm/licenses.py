"""License scans: ordered signature rules behind a keyword prefilter, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import regex_spans

# All that is no digit, letter or beyond ASCII; case doesn't matter where words end.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that always count, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
BASE_SCORE = 0.9

#: Rules, as label, priority, keywords (every match has one of those with / between as a word, and of each part that a + joins), and words; text is lower-cased words with one space between.
_RULES = r"""
mit ~ 100 ~ spdx ~ spdx licen[cs]e identifier (?:mit|expat)
mit-0 ~ 101 ~ spdx ~ spdx licen[cs]e identifier mit 0
apache-2.0 ~ 100 ~ spdx ~ spdx licen[cs]e identifier apache 2 0(?: with llvm exception)?
apache-1.1 ~ 100 ~ spdx ~ spdx licen[cs]e identifier apache 1 [01]
gpl-2.0 ~ 100 ~ spdx ~ spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-3.0 ~ 100 ~ spdx ~ spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
lgpl-2.1 ~ 100 ~ spdx ~ spdx licen[cs]e identifier lgpl 2 [01](?: only| or later)?
lgpl-3.0 ~ 100 ~ spdx ~ spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
agpl-3.0 ~ 100 ~ spdx ~ spdx licen[cs]e identifier agpl [13] 0(?: only| or later)?
bsd-2-clause ~ 100 ~ spdx ~ spdx licen[cs]e identifier bsd 2 clause(?: patent| views)?
bsd-3-clause ~ 100 ~ spdx ~ spdx licen[cs]e identifier bsd 3 clause(?: clear| lbnl)?
bsd-4-clause ~ 100 ~ spdx ~ spdx licen[cs]e identifier bsd 4 clause(?: uc)?
0bsd ~ 100 ~ spdx ~ spdx licen[cs]e identifier 0bsd
mpl-2.0 ~ 100 ~ spdx ~ spdx licen[cs]e identifier mpl 2 0
mpl-1.1 ~ 100 ~ spdx ~ spdx licen[cs]e identifier mpl 1 [01]
isc ~ 100 ~ spdx ~ spdx licen[cs]e identifier isc
zlib ~ 100 ~ spdx ~ spdx licen[cs]e identifier zlib
unlicense ~ 100 ~ spdx ~ spdx licen[cs]e identifier unlicense
cc0-1.0 ~ 100 ~ spdx ~ spdx licen[cs]e identifier cc0 1 0
cc-by-nc-nd ~ 103 ~ spdx ~ spdx licen[cs]e identifier cc by nc nd [1-4] 0
cc-by-nc-sa ~ 103 ~ spdx ~ spdx licen[cs]e identifier cc by nc sa [1-4] 0
cc-by-nc ~ 102 ~ spdx ~ spdx licen[cs]e identifier cc by nc [1-4] 0
cc-by-nd ~ 102 ~ spdx ~ spdx licen[cs]e identifier cc by nd [1-4] 0
cc-by-sa ~ 102 ~ spdx ~ spdx licen[cs]e identifier cc by sa [1-4] 0
cc-by ~ 101 ~ spdx ~ spdx licen[cs]e identifier cc by [1-4] 0
epl-2.0 ~ 100 ~ spdx ~ spdx licen[cs]e identifier epl [12] 0
eupl-1.2 ~ 100 ~ spdx ~ spdx licen[cs]e identifier eupl 1 [0-2]
bsl-1.0 ~ 100 ~ spdx ~ spdx licen[cs]e identifier bsl 1 0
busl-1.1 ~ 100 ~ spdx ~ spdx licen[cs]e identifier busl 1 1
artistic-2.0 ~ 100 ~ spdx ~ spdx licen[cs]e identifier artistic [12] 0(?: perl)?
wtfpl ~ 100 ~ spdx ~ spdx licen[cs]e identifier wtfpl
ofl-1.1 ~ 100 ~ spdx ~ spdx licen[cs]e identifier ofl 1 [01]
other-spdx ~ 60 ~ spdx ~ spdx licen[cs]e identifier [a-z0-9]+
mit ~ 95 ~ hereby ~ permission is hereby granted free of charge to any person obtaining a copy
mit ~ 94 ~ copyright ~ the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc ~ 94 ~ permission ~ permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee
hpnd ~ 90 ~ permission ~ permission to use copy modify and distribute this software and its documentation for any purpose
zlib ~ 94 ~ permission ~ permission is granted to anyone to use this software for any purpose including commercial applications
bsd-2-clause ~ 70 ~ redistribution ~ redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause ~ 93 ~ neither ~ neither the name of .{1,80} nor the names of (?:its|the) contributors may be used
bsd-4-clause ~ 93 ~ advertising ~ all advertising materials mentioning features or use of this software must display
apache-2.0 ~ 95 ~ apache ~ licensed under the apache license version 2 0 the license you may not use this file except in compliance
apache-1.1 ~ 90 ~ apache ~ this product includes software developed by the apache software foundation
gpl ~ 88 ~ free ~ this (?:program|library|file|package) is free software you can redistribute it and or modify it
gpl-2.0 ~ 94 ~ general ~ under the terms of the gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2
gpl-3.0 ~ 94 ~ general ~ under the terms of the gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3
lgpl-2.1 ~ 94 ~ lesser ~ under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 2(?: 1)?
lgpl-3.0 ~ 94 ~ lesser ~ under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation (?:either )?version 3
agpl-3.0 ~ 94 ~ affero ~ under the terms of the gnu affero general public licen[cs]e as published by the free software foundation
gpl ~ 84 ~ general ~ you should have received a copy of the gnu general public licen[cs]e
lgpl ~ 85 ~ lesser ~ you should have received a copy of the gnu lesser general public licen[cs]e
agpl-3.0 ~ 85 ~ affero ~ you should have received a copy of the gnu affero general public licen[cs]e
mpl-2.0 ~ 95 ~ mozilla ~ this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1.1 ~ 94 ~ mozilla ~ the contents of this file are subject to the mozilla public licen[cs]e version 1 1
cddl-1.0 ~ 94 ~ development ~ subject to the terms of the common development and distribution licen[cs]e
epl-1.0 ~ 94 ~ eclipse ~ made available under the terms of the eclipse public licen[cs]e v ?1 0
epl-2.0 ~ 94 ~ eclipse ~ made available under the terms of the eclipse public licen[cs]e (?:v ?)?2 0
unlicense ~ 95 ~ unencumbered ~ this is free and unencumbered software released into the public domain
wtfpl ~ 95 ~ fuck ~ do what the fuck you want to(?: public licen[cs]e)?
bsl-1.0 ~ 94 ~ boost ~ distributed under the boost software licen[cs]e version 1 0
ofl-1.1 ~ 94 ~ sil ~ this font software is licensed under the sil open font licen[cs]e
artistic-2.0 ~ 92 ~ artistic/perl ~ under the same terms as perl itself|under (?:the terms of )?the artistic licen[cs]e 2 0
ncsa ~ 92 ~ illinois ~ university of illinois (?:ncsa )?open source licen[cs]e
mit ~ 90 ~ mit+licensed/released/distributed/available/published ~ (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the |an? )?mit(?: licen[cs]e)?
apache-2.0 ~ 90 ~ apache ~ (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[cs]e)?(?: v(?:ersion)?)? 2(?: 0)?
apache-2.0 ~ 80 ~ apache ~ (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?apache licen[cs]e
bsd-3-clause ~ 91 ~ bsd/freebsd ~ (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the |an? )?(?:3 clause|three clause|new|modified|revised) bsd(?: licen[cs]e)?
bsd-2-clause ~ 91 ~ bsd/freebsd ~ (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the |an? )?(?:2 clause|two clause|simplified) bsd(?: licen[cs]e)?
bsd ~ 82 ~ bsd/freebsd ~ (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the |an? )?bsd(?: style)?(?: licen[cs]e)?
gpl-2.0 ~ 91 ~ gpl/gpl2/gpl3/gplv2/gplv3 ~ (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: v ?| version |v| )?2(?: 0)?
gpl-3.0 ~ 91 ~ gpl/gpl2/gpl3/gplv2/gplv3 ~ (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: v ?| version |v| )?3(?: 0)?
gpl ~ 83 ~ gpl/gpl2/gpl3/gplv2/gplv3 ~ (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
lgpl ~ 86 ~ lgpl/lgpl2/lgpl3/lgplv2/lgplv3 ~ (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
cc-by-nc-nd ~ 93 ~ commons ~ under (?:the |a )?creative commons attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc-sa ~ 93 ~ commons ~ under (?:the |a )?creative commons attribution non ?commercial share ?alike
cc-by-nc ~ 92 ~ commons ~ under (?:the |a )?creative commons attribution non ?commercial
cc-by-nd ~ 92 ~ commons ~ under (?:the |a )?creative commons attribution no ?deriv(?:ative)?s?
cc-by-sa ~ 92 ~ commons ~ under (?:the |a )?creative commons attribution share ?alike
cc-by ~ 91 ~ commons ~ under (?:the |a )?creative commons attribution(?: [1-4] 0)?(?: international| unported)?(?: licen[cs]e)?
apache-2.0 ~ 88 ~ apache ~ apache org licenses license 2 0
mit ~ 88 ~ opensource ~ opensource org licenses mit(?: license)?
bsd-2-clause ~ 88 ~ opensource ~ opensource org licenses bsd 2 clause
bsd-3-clause ~ 88 ~ opensource ~ opensource org licenses bsd 3 clause
isc ~ 88 ~ opensource ~ opensource org licenses isc
gpl-2.0 ~ 88 ~ gnu ~ gnu org licenses (?:old licenses )?gpl 2 0
gpl-3.0 ~ 88 ~ gnu ~ gnu org licenses gpl 3 0
gpl ~ 78 ~ gnu ~ gnu org (?:licenses|copyleft) gpl
lgpl ~ 78 ~ gnu ~ gnu org (?:licenses|copyleft) (?:old licenses )?lgpl
agpl-3.0 ~ 88 ~ gnu ~ gnu org licenses agpl(?: 3 0)?
gfdl-1.3 ~ 88 ~ gnu ~ gnu org (?:licenses|copyleft) fdl(?: 1 [1-3])?
mpl-2.0 ~ 88 ~ mozilla ~ mozilla org (?:mpl|en us mpl) 2 0
mpl-1.1 ~ 78 ~ mozilla ~ mozilla org mpl
cc-by-nc-nd ~ 89 ~ creativecommons ~ creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa ~ 89 ~ creativecommons ~ creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc ~ 88 ~ creativecommons ~ creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd ~ 88 ~ creativecommons ~ creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa ~ 88 ~ creativecommons ~ creativecommons org licenses by sa(?: [1-4] [05])?
cc-by ~ 87 ~ creativecommons ~ creativecommons org licenses by(?: [1-4] [05])?
cc0-1.0 ~ 88 ~ creativecommons ~ creativecommons org publicdomain zero(?: 1 0)?
public-domain ~ 88 ~ creativecommons ~ creativecommons org publicdomain mark(?: 1 0)?
unlicense ~ 88 ~ unlicense ~ unlicense org
wtfpl ~ 88 ~ wtfpl ~ wtfpl net
epl-2.0 ~ 88 ~ eclipse ~ eclipse org legal epl (?:2 0|v20)
epl-1.0 ~ 88 ~ eclipse ~ eclipse org legal epl v10
bsl-1.0 ~ 88 ~ boost ~ boost org license 1 0
ofl-1.1 ~ 88 ~ sil ~ scripts sil org ofl
mit-0 ~ 76 ~ attribution ~ mit no attribution
mit ~ 75 ~ mit+license/licence ~ (?:the )?mit (?:style )?licen[cs]e
mit ~ 75 ~ license/licence/licensed/licenced ~ (?:expat|x11) licen[cs]e
apache-1.1 ~ 76 ~ apache ~ apache (?:software )?licen[cs]e v?(?:ersion )?1 [01]
apache-2.0 ~ 75 ~ apache ~ apache (?:software )?licen[cs]e(?: v?(?:ersion )?2(?: 0)?)?
apache-2.0 ~ 74 ~ apache ~ apache 2 0
0bsd ~ 76 ~ bsd/freebsd ~ (?:bsd zero clause|zero clause bsd|0 clause bsd)
bsd-2-clause ~ 76 ~ bsd/freebsd ~ (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)
bsd-3-clause ~ 76 ~ bsd/freebsd ~ (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)
bsd-4-clause ~ 76 ~ bsd/freebsd ~ (?:original bsd|bsd 4 clause|4 clause bsd)
bsd ~ 70 ~ bsd/freebsd ~ bsd (?:style )?licen[cs]ed?
agpl-3.0 ~ 77 ~ affero ~ (?:gnu )?affero general public licen[cs]e(?: v?(?:ersion )?3(?: 0)?)?
agpl-3.0 ~ 76 ~ agpl/agpl3/agplv3 ~ (?:gnu )?agpl(?:(?: v ?| version |v| )?3(?: 0)?)?(?: only| or later)?
gpl-2.0 ~ 77 ~ general ~ (?:gnu )?general public licen[cs]e v?(?:ersion )?2(?: 0)?
gpl-3.0 ~ 77 ~ general ~ (?:gnu )?general public licen[cs]e v?(?:ersion )?3(?: 0)?
gpl ~ 72 ~ general ~ gnu general public licen[cs]e
gpl ~ 71 ~ public+license/licence ~ gnu public licen[cs]e|general public licen[cs]e
gpl-2.0 ~ 76 ~ gpl/gpl2/gpl3/gplv2/gplv3 ~ (?:gnu )?gpl(?: v| version )? ?2(?: 0)?(?: only| or later)?|gplv2
gpl-3.0 ~ 76 ~ gpl/gpl2/gpl3/gplv2/gplv3 ~ (?:gnu )?gpl(?: v| version )? ?3(?: 0)?(?: only| or later)?|gplv3
gpl ~ 70 ~ gpl/gpl2/gpl3/gplv2/gplv3 ~ gnu gpl|gpl licen[cs]ed?
lgpl-2.1 ~ 78 ~ general ~ (?:gnu )?(?:lesser|library) general public licen[cs]e v?(?:ersion )?2(?: [01])?
lgpl-3.0 ~ 78 ~ general ~ (?:gnu )?lesser general public licen[cs]e v?(?:ersion )?3(?: 0)?
lgpl ~ 74 ~ general ~ (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl-2.1 ~ 77 ~ lgpl/lgpl2/lgpl3/lgplv2/lgplv3 ~ lgpl(?: v| version )? ?2(?: [01])?(?: only| or later)?|lgplv2(?: 1)?
lgpl-3.0 ~ 77 ~ lgpl/lgpl2/lgpl3/lgplv2/lgplv3 ~ lgpl(?: v| version )? ?3(?: 0)?(?: only| or later)?|lgplv3
lgpl ~ 71 ~ lgpl/lgpl2/lgpl3/lgplv2/lgplv3 ~ gnu lgpl|lgpl licen[cs]ed?
gfdl-1.3 ~ 75 ~ documentation ~ (?:gnu )?free documentation licen[cs]e(?: v?(?:ersion )?1 [1-3])?
mpl-1.1 ~ 76 ~ mozilla ~ mozilla public licen[cs]e v?(?:ersion )?1 [01]
mpl-2.0 ~ 75 ~ mozilla ~ mozilla public licen[cs]e(?: v?(?:ersion )?2(?: 0)?)?
mpl-2.0 ~ 74 ~ mpl/mpl2/mplv2 ~ mpl(?: v| version )? ?2 0|mplv2
epl-1.0 ~ 76 ~ eclipse ~ eclipse public licen[cs]e v?(?:ersion )? ?1(?: 0)?
epl-2.0 ~ 75 ~ eclipse ~ eclipse public licen[cs]e(?: v?(?:ersion )? ?2(?: 0)?)?
cddl-1.0 ~ 75 ~ development ~ common development and distribution licen[cs]e
cpl-1.0 ~ 75 ~ common ~ common public licen[cs]e
ecl-2.0 ~ 75 ~ educational ~ educational community licen[cs]e
afl-3.0 ~ 75 ~ academic ~ academic free licen[cs]e
artistic-2.0 ~ 75 ~ artistic ~ (?:perl )?artistic licen[cs]e(?: v?(?:ersion )?[12](?: 0)?)?
bsl-1.0 ~ 75 ~ boost ~ boost software licen[cs]e
busl-1.1 ~ 75 ~ business ~ business source licen[cs]e
cecill-2.1 ~ 75 ~ cecill ~ cecill(?: [abc])?(?: free software)?(?: licen[cs]e)?
eupl-1.2 ~ 75 ~ european ~ european union public licen[cs]e
hpnd ~ 75 ~ historical ~ historical permission notice and disclaimer
isc ~ 75 ~ isc ~ isc licen[cs]ed?
lppl-1.3c ~ 75 ~ latex ~ latex project public licen[cs]e
ms-pl ~ 75 ~ microsoft ~ microsoft public licen[cs]e
ms-rl ~ 75 ~ microsoft ~ microsoft reciprocal licen[cs]e
ncsa ~ 75 ~ ncsa ~ ncsa(?: open source)? licen[cs]e
odbl-1.0 ~ 76 ~ database ~ open (?:data commons open )?database licen[cs]e
odc-by ~ 75 ~ commons ~ open data commons attribution(?: licen[cs]e)?
pddl-1.0 ~ 77 ~ dedication ~ public domain dedication and licen[cs]e
ofl-1.1 ~ 75 ~ font ~ (?:sil )?open font licen[cs]e
ogl-3.0 ~ 75 ~ government ~ open government licen[cs]e(?: v[1-3](?: 0)?)?
openssl ~ 75 ~ openssl ~ openssl licen[cs]e
osl-3.0 ~ 75 ~ software ~ open software licen[cs]e(?: v?(?:ersion )?[1-3](?: 0)?)?
php-3.01 ~ 75 ~ php ~ php licen[cs]e
postgresql ~ 75 ~ postgresql ~ postgresql licen[cs]e
psf-2.0 ~ 75 ~ license/licence/licensed/licenced ~ (?:python software foundation|psf|python) licen[cs]e
qpl-1.0 ~ 75 ~ q ~ q public licen[cs]e
ruby ~ 75 ~ ruby ~ ruby licen[cs]e
sspl-1.0 ~ 75 ~ server ~ server side public licen[cs]e
elastic-2.0 ~ 75 ~ elastic ~ elastic licen[cs]e(?: 2 0)?
unlicense ~ 75 ~ unlicense ~ (?:the )?unlicense
upl-1.0 ~ 75 ~ permissive ~ universal permissive licen[cs]e
vim ~ 75 ~ vim ~ vim licen[cs]e
w3c ~ 75 ~ w3c ~ w3c (?:software )?(?:notice and )?licen[cs]e
wtfpl ~ 75 ~ wtfpl ~ wtfpl
zlib ~ 75 ~ zlib ~ zlib(?: libpng)? licen[cs]e
zpl-2.1 ~ 75 ~ zope ~ zope public licen[cs]e
openrail ~ 75 ~ openrail/rail ~ (?:creativeml |bigscience )?open ?rail(?: [a-z])?(?: licen[cs]e)?
cc0-1.0 ~ 75 ~ cc0 ~ cc0(?: 1 0)?(?: universal)?
cc0-1.0 ~ 75 ~ commons ~ creative commons zero
cc-by-nc-nd ~ 73 ~ cc ~ cc by nc nd(?: [1-4] 0)?
cc-by-nc-sa ~ 73 ~ cc ~ cc by nc sa(?: [1-4] 0)?
cc-by-nc ~ 72 ~ cc ~ cc by nc(?: [1-4] 0)?
cc-by-nd ~ 72 ~ cc ~ cc by nd(?: [1-4] 0)?
cc-by-sa ~ 72 ~ cc ~ cc by sa(?: [1-4] 0)?
cc-by ~ 71 ~ cc ~ cc by(?: [1-4] 0)?
cc-by ~ 71 ~ commons ~ creative commons attribution
cc-by-nc-nd ~ 73 ~ attribution ~ attribution non ?commercial no ?deriv(?:ative)?s?
cc-by-nc-sa ~ 73 ~ attribution ~ attribution non ?commercial share ?alike
cc-by-nc ~ 72 ~ attribution ~ attribution non ?commercial
cc-by-sa ~ 72 ~ attribution ~ attribution share ?alike
creative-commons ~ 40 ~ commons ~ creative commons(?: licen[cs]e)?
public-domain ~ 50 ~ domain ~ (?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain ~ 45 ~ domain ~ public domain
reserved ~ 35 ~ reserved ~ (?:all|some|no) rights reserved
copyright ~ 30 ~ copyright ~ copyright (?:c )?(?:19|20)[0-9]{2}
copyright ~ 25 ~ copyright ~ copyright
proprietary ~ 40 ~ proprietary ~ (?:proprietary (?:and confidential|licen[cs]e|software)|confidential and proprietary)
eula ~ 40 ~ end ~ end user licen[cs]e agreement
commercial ~ 40 ~ commercial ~ commercial licen[cs]e
no-commercial ~ 40 ~ commercial ~ (?:no|not for|non) commercial use
no-redistribution ~ 40 ~ redistribute/redistributed/redistribution ~ (?:no redistribution|may not (?:be )?redistribut(?:e|ed))
as-is ~ 20 ~ warranty/warranties ~ without (?:any )?warrant(?:y|ies)(?: of any kind)?
unknown-license ~ 15 ~ license/licence/licensed/licenced ~ (?:licen[cs]ed under|under (?:the )?licen[cs]e|see licen[cs]e|licen[cs]e agreement)
"""


def rules() -> list[tuple[str, int, str, str]]:
    """All rules as (label, priority, keywords, regular expression), in order of priority."""
    split = [line.split(" ~ ") for line in _RULES.strip().splitlines()]
    return sorted([(label, int(priority), keyword, words) for label, priority, keyword, words in split], key=lambda r: -r[1])


def keywords(base: tuple[tuple[str, str], ...] = ()) -> list[str]:
    """Words one of which is in every text that any rule or phrase fits."""
    return sorted({k for _, _, ks, _ in rules() for part in ks.split("+") for k in part.split("/")} | {phrase.split(" ")[0] for phrase, _ in base})


def _phrase_starts(wrapped: Column, phrase: str) -> Column:
    """Word numbers at which a phrase stands, in a text in which each word has a space on either side."""
    n = phrase.count(" ") + 1
    gaps = F.split(wrapped, " " + phrase.replace(" ", "  ") + " ", -1)
    words = F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g: (F.length(g) - F.length(F.replace(g, F.lit(" ")))) / 2)
    return F.aggregate(words, F.array().cast("array<long>"), lambda done, k: F.concat(done, F.array((F.coalesce(F.try_element_at(done, F.lit(-1)) + n, F.lit(0)) + k).cast("long"))))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """A row for each row of ``docs``: the id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; null text is empty. Base phrases
    are counted wherever their words follow one another. Rules find more, over lower-cased words with one space
    between: a rule's detection is dropped where one of higher priority, or of the same and longer, contains it.
    detections is array<struct<label, priority, start, end>>, places in those words' text. score is the highest
    priority / 100 of what is left, at least 0.9 with a base phrase, else 0. Empty texts and tables, repeated rows and
    any other columns are fine: each row is judged alone, in the JVM, with no shuffle.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.trim(F.regexp_replace(text, _GAP, " "))
    step = docs.select(F.col(id_col), norm.alias("__norm")).withColumn("__low", F.lower("__norm"))
    known = F.array(*(F.lit(k) for k in keywords(base)))
    exact = F.translate("__norm", _UPPER, _LOWER)
    # One pass over a text's words finds all keywords in it; with none it is done.
    step = step.withColumn("__keys", F.array_intersect(F.split("__low", " ", -1), known))
    has = lambda own: F.arrays_overlap("__keys", F.array(*(F.lit(k) for k in own.split("/"))))
    there = lambda own: reduce(and_, map(has, own.split("+")))
    sets = dict.fromkeys([ks for _, _, ks, _ in rules()] + [phrase.split(" ")[0] for phrase, _ in base])
    step = step.withColumn("__gate", F.when(F.size("__keys") > 0, reduce(or_, map(there, sets))).otherwise(False))
    step = step.withColumn("__words", F.when(F.col("__gate"), exact))
    starts = {}
    for i, (phrase, _) in enumerate(base):
        wrapped = F.concat(F.lit(" "), F.replace("__words", F.lit(" "), F.lit("  ")), F.lit(" "))
        starts[f"__b{i}"] = F.when(F.col("__gate") & F.contains(F.col("__words"), F.lit(phrase)), _phrase_starts(wrapped, phrase)).otherwise(F.array().cast("array<long>"))
    step = step.withColumn("__padded", F.concat(F.lit(" "), F.col("__words"), F.lit(" ")))
    padded = F.col("__padded")
    by_keywords: dict[str, list[tuple[str, int, str]]] = {}
    for label, priority, own, words in rules():
        by_keywords.setdefault(own, []).append((label, priority, words))

    def spans(label: str, priority: int, words: str) -> Column:
        # A pattern that is part of the plan is compiled once.
        return F.transform(regex_spans(padded, F.lit(f"(?<= )(?:{words})(?= )")), lambda s: F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), s["start"].alias("start"), s["end"].alias("end")))

    nothing = F.array().cast("array<struct<label:string,priority:int,start:int,end:int>>")
    found = F.concat(*(F.when(there(own), F.concat(*(spans(*r) for r in made))).otherwise(nothing) for own, made in by_keywords.items()))
    none = F.array().cast("array<struct<label:string,priority:int,start:int,end:int>>")

    def over(o: Column, d: Column) -> Column:
        longer = (o["end"] - o["start"]) > (d["end"] - d["start"])
        return (o["start"] <= d["start"]) & (o["end"] >= d["end"]) & ((o["priority"] > d["priority"]) | (o["priority"] == d["priority"]) & longer)

    step = step.withColumns(starts | {"__found": F.when(F.col("__gate"), found).otherwise(none)})
    step = step.withColumn("detections", F.filter("__found", lambda d: ~F.exists("__found", lambda o: over(o, d))))
    places = F.concat(*(F.col(f"__b{i}") for i in range(len(base))))
    own = F.array_compact(F.array(*(F.when(F.size(f"__b{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(base))))
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / 100.0
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    spaces = F.length("__norm") - F.length(F.replace("__norm", F.lit(" ")))
    return step.select(
        id_col, F.when(F.col("__norm") == "", 0).otherwise(spaces + 1).cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), join(own).alias("base_labels"),
        join(F.concat(own, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        F.greatest(best, F.when(F.size(places) > 0, BASE_SCORE).otherwise(0.0)).alias("score"), "detections",
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all documents; nulls, ties and repeats as in :func:`scan_licenses`."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
