"""License scans by ordered signature rules, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: License families as (label, names, versions); "2 0" is what words keep of "2.0".
FAMILIES = [
    ("apache", ["apache license", "apache software license", "apache"], ["1 0", "1 1", "2 0", "2"]),
    ("gpl", ["gnu general public license", "general public license", "gnu gpl", "gpl"], ["1", "1 0", "2", "2 0", "3", "3 0"]),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "lesser general public license", "lgpl"], ["2", "2 0", "2 1", "3", "3 0"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "agpl"], ["1", "1 0", "3", "3 0"]),
    ("fdl", ["gnu free documentation license", "gfdl"], ["1 1", "1 2", "1 3"]),
    ("mpl", ["mozilla public license", "mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public license", "epl"], ["1 0", "2 0"]),
    ("cddl", ["common development and distribution license", "cddl"], ["1 0", "1 1"]),
    ("eupl", ["european union public licence", "eupl"], ["1 0", "1 1", "1 2"]),
    ("artistic", ["artistic license"], ["1 0", "2 0"]),
    ("afl", ["academic free license"], ["2 1", "3 0"]),
    ("osl", ["open software license"], ["1 0", "2 0", "2 1", "3 0"]),
    ("cecill", ["cecill"], ["1 0", "2 0", "2 1"]),
    ("zpl", ["zope public license"], ["1 1", "2 0", "2 1"]),
    ("boost", ["boost software license"], ["1 0"]),
    ("ofl", ["sil open font license", "open font license"], ["1 0", "1 1"]),
    ("psf", ["python software foundation license", "psf license"], ["2"]),
    ("odbl", ["open database license", "odbl"], ["1 0"]),
    ("mit", ["mit license", "the mit license", "expat license"], []),
    ("bsd", ["bsd license", "2 clause bsd license", "3 clause bsd license", "4 clause bsd license", "bsd 2 clause license", "bsd 3 clause license"], []),
    ("isc", ["isc license"], []),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("wtfpl", ["do what the fuck you want to public license", "wtfpl"], ["2"]),
    ("public-domain", ["unlicense", "public domain dedication", "dedicated to the public domain", "cc0"], ["1 0"]),
]
CREATIVE = ["", "nc", "sa", "nd", "nc sa", "nc nd"]
CREATIVE_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
CREATIVE_NAMES = {"": "attribution", "nc": "attribution noncommercial", "sa": "attribution sharealike", "nd": "attribution noderivatives", "nc sa": "attribution noncommercial sharealike", "nc nd": "attribution noncommercial noderivatives"}
#: Hand-written signatures: label, weight, keyword, and words, each one an expression; a word with a question mark may be absent.
SIGNATURES = [
    ("reserved", 0.3, "all rights reserved", "all rights reserved"),
    ("reserved", 0.4, "all rights reserved", "copyright [0-9]{4} all rights reserved"),
    ("reserved", 0.4, "all rights reserved", "copyright all rights reserved"),
    ("reserved", 0.4, "rights reserved", "(?:some|no) rights reserved"),
    ("proprietary", 0.6, "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", 0.6, "confidential and proprietary", "confidential and proprietary"),
    ("proprietary", 0.8, "unauthorized copying of this", "unauthorized copying of this (?:file|document|work)"),
    ("proprietary", 0.8, "strictly prohibited", "reproduction or? distribution in? whole? or? in? part? is strictly prohibited"),
    ("proprietary", 0.7, "for internal use only", "for internal use only"),
    ("proprietary", 0.7, "end user license agreement", "end user license agreement"),
    ("mit", 1.0, "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 0.9, "the above copyright notice and this permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit", 0.9, "mit license", "(?:licensed|released|distributed|available) under the? mit license"),
    ("mit", 0.8, "mit licensed", "mit licensed"),
    ("mit", 0.8, "x11 license", "x11 license"),
    ("mit-0", 0.9, "mit no attribution", "mit no attribution license?"),
    ("mit-0", 0.9, "mit 0", "mit 0 license"),
    ("bsd", 1.0, "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 0.8, "bsd style license", "bsd style license"),
    ("bsd-2-clause", 0.9, "bsd 2 clause", "bsd 2 clause license?"),
    ("bsd-2-clause", 0.9, "simplified bsd", "simplified bsd license"),
    ("bsd-2-clause", 0.9, "freebsd license", "freebsd license"),
    ("bsd-2-clause-patent", 0.9, "bsd 2 clause patent", "bsd 2 clause patent license?"),
    ("bsd-3-clause", 0.9, "bsd 3 clause", "bsd 3 clause license?"),
    ("bsd-3-clause", 0.9, "3 clause bsd", "3 clause bsd license?"),
    ("bsd-3-clause", 0.9, "new bsd license", "new bsd license"),
    ("bsd-3-clause", 0.9, "modified bsd license", "modified bsd license"),
    ("bsd-3-clause", 0.9, "endorse or promote products derived", "may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", 0.9, "bsd 3 clause clear", "bsd 3 clause clear license?"),
    ("bsd-4-clause", 0.9, "bsd 4 clause", "bsd 4 clause license?"),
    ("bsd-4-clause", 0.9, "original bsd license", "original bsd license"),
    ("bsd-4-clause", 0.9, "all advertising materials mentioning features", "all advertising materials mentioning features or use of this software"),
    ("0bsd", 0.9, "0bsd", "0bsd"),
    ("0bsd", 0.9, "zero clause bsd", "zero clause bsd license?"),
    ("isc", 1.0, "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", 0.9, "permission to use copy modify and distribute this software", "permission to use copy modify and distribute this software for any purpose"),
    ("isc", 0.7, "isc licensed", "isc licensed"),
    ("zlib", 1.0, "altered source versions must be plainly marked", "altered source versions must be plainly marked as such"),
    ("zlib", 0.9, "the origin of this software must not be misrepresented", "the origin of this software must not be misrepresented"),
    ("libpng", 0.9, "libpng license", "libpng license"),
    ("apache-2.0", 1.0, "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", 0.9, "you may not use this file except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", 0.8, "apache 2", "apache 2 0? licensed?"),
    ("apache-2.0", 0.8, "asl 2", "asl 2 0?"),
    ("apache-2.0", 0.8, "alv2", "alv2"),
    ("apache-1.1", 0.9, "apache 1 1", "apache 1 1"),
    ("gpl-2.0-or-later", 1.0, "either version 2 of the license or", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 1.0, "either version 3 of the license or", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", 0.9, "gplv2", "gplv2 0?"),
    ("gpl-2.0", 0.8, "gpl2", "gpl2"),
    ("gpl-2.0-only", 0.9, "gpl 2 0 only", "gpl 2 0 only"),
    ("gpl-2.0-only", 0.9, "gplv2 only", "gplv2 only"),
    ("gpl-2.0-or-later", 0.9, "gpl 2 0 or later", "gpl 2 0 or later"),
    ("gpl-2.0-or-later", 0.9, "gplv2 or later", "gplv2 or later"),
    ("gpl-2.0-or-later", 0.9, "gpl version 2 or later", "gpl version 2 or later"),
    ("gpl-3.0", 0.9, "gplv3", "gplv3 0?"),
    ("gpl-3.0", 0.8, "gpl3", "gpl3"),
    ("gpl-3.0-only", 0.9, "gpl 3 0 only", "gpl 3 0 only"),
    ("gpl-3.0-only", 0.9, "gplv3 only", "gplv3 only"),
    ("gpl-3.0-or-later", 0.9, "gpl 3 0 or later", "gpl 3 0 or later"),
    ("gpl-3.0-or-later", 0.9, "gplv3 or later", "gplv3 or later"),
    ("gpl-3.0-or-later", 0.9, "gpl version 3 or later", "gpl version 3 or later"),
    ("gpl", 0.7, "free software foundation", "as published by the free software foundation"),
    ("gpl", 0.6, "copyleft", "copyleft license"),
    ("gpl-exception", 0.9, "classpath exception", "(?:gpl|license|with) with? the? classpath exception"),
    ("lgpl-2.1", 0.9, "lgplv2", "lgplv2 1?"),
    ("lgpl-3.0", 0.9, "lgplv3", "lgplv3 0?"),
    ("lgpl-2.1-only", 0.9, "lgpl 2 1 only", "lgpl 2 1 only"),
    ("lgpl-2.1-or-later", 0.9, "lgpl 2 1 or later", "lgpl 2 1 or later"),
    ("lgpl-3.0-only", 0.9, "lgpl 3 0 only", "lgpl 3 0 only"),
    ("lgpl-3.0-or-later", 0.9, "lgpl 3 0 or later", "lgpl 3 0 or later"),
    ("agpl-3.0", 0.9, "agplv3", "agplv3 0?"),
    ("agpl-3.0-only", 0.9, "agpl 3 0 only", "agpl 3 0 only"),
    ("agpl-3.0-or-later", 0.9, "agpl 3 0 or later", "agpl 3 0 or later"),
    ("mpl-2.0", 1.0, "this source code form is subject to the terms of the mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 0.9, "mplv2", "mplv2 0?"),
    ("mpl-1.1", 1.0, "the contents of this file are subject to the mozilla public license", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", 1.0, "this program and the accompanying materials are made available under the terms of the eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license v? 2 0"),
    ("epl-1.0", 0.9, "eplv1", "eplv1 0?"),
    ("cddl-1.0", 0.9, "cddl 1 0", "cddl 1 0"),
    ("bsl-1.0", 1.0, "distributed under the boost software license", "distributed under the boost software license version 1 0"),
    ("bsl-1.0", 0.9, "boost license", "boost license"),
    ("busl-1.1", 0.9, "business source license", "business source license 1? 1?"),
    ("sspl-1.0", 0.9, "server side public license", "server side public license version? v? 1?"),
    ("elastic-2.0", 0.9, "elastic license", "elastic license 2? 0?"),
    ("unlicense", 1.0, "this is free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 0.9, "the unlicense", "the unlicense"),
    ("public-domain", 0.8, "in the public domain", "(?:is|are|been|placed|released) placed? in the public domain"),
    ("public-domain", 0.9, "into the public domain", "(?:released|placed|dedicated) into the public domain"),
    ("cc0-1.0", 0.9, "cc0 1 0", "cc0 1 0 universal?"),
    ("cc0-1.0", 1.0, "waived all copyright and related", "waived all copyright and related or neighboring rights"),
    ("cc-by", 0.7, "creative commons attribution", "creative commons attribution licen[cs]e"),
    ("cc-by", 0.7, "creativecommons org licenses by", "creativecommons org licenses by"),
    ("cc-by-4.0", 0.9, "creativecommons org licenses by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-3.0", 0.9, "creativecommons org licenses by 3 0", "creativecommons org licenses by 3 0"),
    ("cc-by-sa", 0.7, "creativecommons org licenses by sa", "creativecommons org licenses by sa"),
    ("cc-by-sa-4.0", 0.9, "creativecommons org licenses by sa 4 0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3.0", 0.9, "creativecommons org licenses by sa 3 0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-nc-4.0", 0.9, "creativecommons org licenses by nc 4 0", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", 0.9, "creativecommons org licenses by nd 4 0", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", 0.9, "creativecommons org licenses by nc sa 4 0", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", 0.9, "creativecommons org licenses by nc nd 4 0", "creativecommons org licenses by nc nd 4 0"),
    ("cc0-1.0", 0.9, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1? 0?"),
    ("cc", 0.5, "creative commons license", "creative commons license"),
    ("cc", 0.5, "creative commons licence", "creative commons licence"),
    ("odbl-1.0", 0.9, "odbl 1 0", "odbl 1 0"),
    ("odc-by-1.0", 0.9, "odc by", "odc by 1? 0?"),
    ("odc-by-1.0", 0.9, "open data commons attribution", "open data commons attribution license"),
    ("pddl-1.0", 0.9, "public domain dedication and license", "public domain dedication and license"),
    ("ogl-uk-3.0", 0.9, "open government licence", "open government licence version? v? 3 0"),
    ("ogl-uk", 0.7, "open government licence", "open government licence"),
    ("etalab-2.0", 0.9, "licence ouverte", "licence ouverte open? licence? version? 2? 0?"),
    ("ofl-1.1", 1.0, "this font software is licensed under the sil open font license", "this font software is licensed under the sil open font license version 1 1"),
    ("psf-2.0", 0.9, "psf 2", "psf 2 0?"),
    ("python-2.0", 0.9, "python license", "python license 2? 0?"),
    ("ruby", 0.8, "ruby license", "ruby license"),
    ("php-3.01", 0.9, "php license", "php license version? v? 3 01"),
    ("artistic-2.0", 0.9, "artistic 2", "artistic 2 0?"),
    ("artistic", 0.6, "perl artistic license", "perl artistic license"),
    ("openssl", 0.8, "openssl license", "openssl license"),
    ("curl", 0.8, "curl license", "curl license"),
    ("vim", 0.8, "vim license", "vim license"),
    ("postgresql", 0.9, "postgresql license", "postgresql license"),
    ("ms-pl", 0.9, "microsoft public license", "microsoft public license"),
    ("ms-pl", 0.9, "ms pl", "ms pl"),
    ("ms-rl", 0.9, "microsoft reciprocal license", "microsoft reciprocal license"),
    ("ncsa", 0.9, "university of illinois ncsa open source license", "university of illinois ncsa open source license"),
    ("beerware", 0.9, "beerware license", "beerware license"),
    ("beerware", 1.0, "buy me a beer in return", "buy me a beer in return"),
    ("json", 0.9, "the software shall be used for good not evil", "the software shall be used for good not evil"),
    ("openrail", 0.8, "openrail", "(?:creativeml|bigscience)? openrail m?"),
    ("llama", 0.8, "community license agreement", "community license agreement"),
    ("tdm-reserved", 0.7, "text and data mining", "text and data mining (?:is|are|rights|reserved|prohibited)"),
    ("no-ai", 0.7, "be used to train", "not be used to train (?:ai|machine|artificial|large|language)"),
    ("warranty", 0.4, "without warranty of any kind", "without warranty of any kind"),
    ("warranty", 0.4, "without any warranty", "without any warranty"),
    ("warranty", 0.4, "as is without", "as is without (?:warranty|warranties)"),
    ("warranty", 0.3, "provided as is", "provided as is"),
    ("dual", 0.8, "dual licensed", "dual licensed under"),
]
SPDX = "spdx license identifier"
LEADS = "(?: licensed | released | distributed | available | published )(?: under )(?: the | a | an )?"


def unit(words: str) -> str:
    """A pattern for words that stand consecutively; each word of a text has a space on both of its sides."""
    return "".join(f" {w} " for w in words.split())


def signature(words: str) -> str:
    """A signature's pattern: each word between its spaces; one with a question mark may be absent."""
    return "".join(f"(?: {w[:-1]} )?" if w.endswith("?") else f" {w} " for w in words.split())


def rules() -> list[tuple[int, str, str, str, float]]:
    """``(priority, label, keyword, pattern, weight)``: the ordered signatures, most specific first.

    The keyword is a phrase that any match of the pattern contains. Signatures
    are written by hand; forms with versions are the families' names times their
    versions, bare and after a grant, and every label's name after an SPDX tag.
    """
    found: list[tuple[str, str, str, float]] = []
    version = "(?: version | v | ver )?"
    for label, names, versions in FAMILIES:
        for name in names:
            for v in versions:
                full = f"{label}-{v.replace(' ', '.')}"
                tail = f"(?: license )?{version}{unit(v)}"
                found += [(full, name, LEADS + unit(name) + tail, 1.0), (full, name, unit(name) + tail, 0.9)]
            found += [(label, name, LEADS + unit(name), 0.8), (label, name, unit(name), 0.5)]
    for kind in CREATIVE:
        short, full = f"cc by {kind}".strip(), f"creative commons {CREATIVE_NAMES[kind]}"
        label = short.replace(" ", "-")
        for v in CREATIVE_VERSIONS:
            tagged = f"{label}-{v.replace(' ', '.')}"
            found += [(tagged, short, LEADS + unit(short) + unit(v), 1.0), (tagged, short, unit(short) + unit(v), 0.9), (tagged, full, unit(full) + f"(?: {v.split()[0]}  {v.split()[1]} | international | license )+", 0.9)]
        found += [(label, short, unit(short), 0.6), (label, full, unit(full), 0.6)]
    found += [(label, keyword, signature(words), weight) for label, weight, keyword, words in SIGNATURES]
    tags = {label for label, *_ in found} - {"reserved", "proprietary", "warranty", "public-domain", "dual", "cc"}
    found += [(label, SPDX, unit(f"{SPDX} {label.replace('-', ' ').replace('.', ' ')}"), 1.0) for label in tags]
    found = sorted(set(found), key=lambda r: (-r[3], -len(r[2]), r[2], r[0]))
    return [(k, *r) for k, r in enumerate(found)]


def keywords() -> list[str]:
    """The rules' keywords that contain no other one: a text with none of them has no match."""
    every = sorted({unit(r[2]) for r in rules()}, key=lambda k: (len(k), k))
    return [k for i, k in enumerate(every) if not any(o in k for o in every[:i])]


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table, some hundreds of rows whatever the input; ``gate`` is one of ``keywords()``. Base phrases are marked."""
    gates = keywords()
    gate = lambda key: next(g for g in gates if g in unit(key))
    rows = [(p, False, label, gate(key), pattern, weight) for p, label, key, pattern, weight in rules()]
    rows += [(-1 - k, True, label, gate(phrase), unit(phrase), 0.0) for k, (phrase, label) in enumerate(PHRASES.items())]
    return spark.createDataFrame(rows, "priority int, base boolean, label string, gate string, pattern string, weight double")


GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The text's words, each with a space on both sides; empty without words."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP, "  "))
    return F.when(words == "", words).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def gate_pattern() -> str:
    """One pattern for all keywords, by their first letters, A-Z in either case."""
    by_letter: dict[str, list[str]] = {}
    for k in keywords():
        by_letter.setdefault(k[1], []).append(k[2:])
    return "(?i) (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + ")"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base phrases and license detections of each whole text.

    Gives ``id, n_words, n_base, first_word, last_word, base_labels, labels,
    score`` and ``n_found``. One pattern of all keywords parts the texts; the few
    that hold one meet only the rules of that keyword (a join with a broadcast
    table of some hundred rules). A rule's pattern parts a text into matches and
    what lies between them; their lengths, added up in order, give each match's
    place, so the work grows in step with the matches. A detection that lies
    inside another one is suppressed; of equal intervals the rule with the
    higher priority stays. ``score`` is the largest weight of what stays: 1 for a
    full grant with a version, 0 without any detection.

    A null or empty text has no words. Texts are read once and not shuffled:
    what goes on is a row for each match, and one for each text without.
    Repeated rows stay apart; an empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("slot"), F.col(id_col).alias("id"), spaced(F.col(text_col)).alias("raw"))
    n_words = F.when(F.col("raw") == "", 0).otherwise(F.length("raw") - F.length(F.replace("raw", F.lit("  "), F.lit(" "))) + 1)
    gated = rows.select("slot", "id", n_words.cast("long").alias("n_words"), F.when(F.col("raw").rlike(gate_pattern()), ascii_lower(F.col("raw"))).alias("spaced"))
    gates = F.filter(F.array(*map(F.lit, keywords())), lambda k: F.col("spaced").contains(k))
    each = gated.select("slot", "id", "n_words", "spaced", F.explode_outer(F.when(F.col("spaced").isNotNull(), gates)).alias("gate"))
    met = each.join(F.broadcast(rule_table(docs.sparkSession)), "gate", "left")
    rule = ["slot", "id", "n_words", "priority", "base", "label", "weight"]
    pieces = F.arrays_zip(F.expr("split(spaced, pattern, -1)").alias("gap"), F.expr("regexp_extract_all(spaced, pattern, 0)").alias("hit"))
    parts = met.select(*rule, F.posexplode_outer(pieces).alias("pos", "x"))
    words = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2
    lengths = [F.length("x.gap").alias("gap"), F.length("x.hit").alias("hit"), *[F.when(F.col("base"), words(F.col(f"x.{c}"))).cast("long").alias(f"{c}_words") for c in ("gap", "hit")]]
    in_order = Window.partitionBy("slot", "priority").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda a, b: F.coalesce(F.sum(F.col(a) + F.col(b)).over(in_order), F.lit(0)) + F.col(a)
    placed = parts.select(*rule, "pos", *lengths).repartition("slot").withColumn("s", before("gap", "hit")).withColumn("word", before("gap_words", "hit_words"))
    placed = placed.withColumn("e", F.col("s") + F.col("hit")).withColumn("real", F.col("hit").isNotNull() & ~F.col("base"))
    earlier = Window.partitionBy("slot").orderBy(F.col("s").asc_nulls_last(), F.desc("e"), "priority").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("real"), F.col("e"))).over(earlier)
    kept = placed.withColumn("reach", reach).withColumn("stays", F.col("real") & (F.col("reach").isNull() | (F.col("e") > F.col("reach")))).withColumn("place", F.when(F.col("base") & F.col("hit").isNotNull(), F.col("word")))
    sorted_set = lambda c: F.array_sort(F.collect_set(c))
    verdict = kept.groupBy("slot").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.count("place").alias("n_base"),
        F.min("place").alias("first_word"),
        F.max("place").alias("last_word"),
        sorted_set(F.when(F.col("place").isNotNull(), F.col("label"))).alias("own"),
        sorted_set(F.when(F.col("place").isNotNull() | F.col("stays"), F.col("label"))).alias("every"),
        F.max(F.when(F.col("stays"), F.col("weight"))).alias("score"),
        F.count_if("stays").alias("n_found"),
    )
    return verdict.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join("every", ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "n_found")


def oracle() -> str:
    """The same rows in DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    gates = keywords()
    table = ",\n".join(f"({p}, {quote(label)}, {quote(next(g for g in gates if g in unit(key)))}, {quote(pattern)}, {weight}::DOUBLE)" for p, label, key, pattern, weight in rules())
    base = " UNION ALL ".join(f"SELECT doc_id, {quote(label)} AS label, unnest(list_filter(range(len(words)), lambda i: {' AND '.join(f'words[i + {k + 1}] = {quote(w)}' for k, w in enumerate(phrase.split()))})) AS place FROM texts WHERE contains(spaced, {quote(unit(phrase))})" for phrase, label in PHRASES.items())
    return f"""
WITH rules(priority, label, gate, pattern, weight) AS (VALUES {table}),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
texts AS (SELECT doc_id, words, CASE WHEN len(words) > 0 THEN ' ' || array_to_string(words, '  ') || ' ' ELSE '' END AS spaced FROM words),
base AS ({base}),
by_base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS own FROM base GROUP BY doc_id),
met AS (SELECT doc_id, priority, label, weight, string_split_regex(spaced, pattern) AS gaps, regexp_extract_all(spaced, pattern) AS hits FROM texts JOIN rules ON contains(spaced, gate) WHERE regexp_matches(spaced, pattern)),
hit AS (SELECT doc_id, priority, label, weight, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM met),
found AS (SELECT DISTINCT doc_id, priority, label, weight, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s, length(hits[i]) AS n FROM hit),
reached AS (SELECT *, s + n AS e, max(s + n) OVER (PARTITION BY doc_id ORDER BY s, s + n DESC, priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM found),
verdict AS (SELECT doc_id, list(DISTINCT label) AS more, max(weight) AS score, count(*) AS n_found FROM reached WHERE reach IS NULL OR e > reach GROUP BY doc_id)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(own), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
       coalesce(score, 0.0::DOUBLE) AS score, coalesce(n_found, 0)::BIGINT AS n_found
FROM texts t LEFT JOIN by_base USING (doc_id) LEFT JOIN verdict USING (doc_id)
"""
