"""License scans with DataFrame expressions only: sparse TF-IDF cosine to templates, then inheritance along directories.

A file's lines, windows of consecutive lines (notices are wrapped), paragraphs (so the header block) and, of a licence file, the
whole text are compared with full and short forms of each licence. Weights are term frequency times inverse document frequency
over the forms, without stop words; a word that no form has weighs as the rarest. Exact bounds come first. Of
each form's words the lightest are set aside as long as their share of its length stays below the threshold, so a part
that reaches it holds one of the others (its anchors): a text without an anchor is never cut into parts. A part can reach the threshold only
if its known words weigh enough against the number of its other words; the sums for lines bound those of windows, so windows
that cannot reach it are never built. What is left is weighed.

Licence files lend their licence to the files below them: distinct directories, not files, are joined with their ancestors, and
the nearest counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import stored

# Short notices by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Proprietary": "All rights reserved.",
}
_SOFTWARE = "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_GRANT = f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files {_SOFTWARE}"
_AS_IS = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
# Forms by SPDX identifier besides TEMPLATES, from which the oracle is made: names, notices, titles, texts.
FORMS = {
    "Apache-2.0": ("Licensed under Apache 2.0.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Distributed under the Apache License 2.0."),
    "GPL-3.0": (_GNU.format("program", "General Public License", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Licensed under the GPL v3.", "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under the GNU General Public License version 3."),
    "GPL-2.0": (_GNU.format("program", "General Public License", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "Licensed under the GPL v2.", "SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "Distributed under the GNU General Public License version 2."),
    "LGPL-3.0": (_GNU.format("library", "Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Licensed under the LGPL v3.", "SPDX-License-Identifier: LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later", "Distributed under the GNU Lesser General Public License version 3."),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", _GRANT, f"MIT License {_GRANT} {_AS_IS}", "SPDX-License-Identifier: MIT", "Distributed under the MIT License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted.", "BSD 3-Clause License.", _BSD, "SPDX-License-Identifier: BSD-3-Clause", "Distributed under the BSD 3-Clause License."),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0", "Distributed under the Mozilla Public License 2.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
}
# MIT's and BSD's entries of TEMPLATES hold two notices each, which stand in FORMS one by one.
NOTICES = {k: t for k, t in TEMPLATES.items() if k not in ("MIT", "BSD-3-Clause")} | {f"{k}#{i}": t for k, forms in FORMS.items() for i, t in enumerate(forms)}
WINDOWS = (2, 3, 4, 6, 8, 12)  # lines
WORD = r"[a-z0-9]+"
# Words without weight.
STOP = "a above all an and any are as at be by can for from he her his i if in into is it its may must no not of on one or other our out shall she so such that the their these they this to was we were which will with you your".split()


def weights(templates: dict[str, str]) -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """(idf of each template word, idf of any other word, unit vectors of the templates)."""
    counts = {k: Counter(w for w in re.findall(WORD, t.lower()) if w not in STOP) for k, t in templates.items()}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((1 + len(templates)) / (1 + n)) + 1 for w, n in df.items()}
    other = math.log(1 + len(templates)) + 1
    unit = {}
    for k, c in counts.items():
        v = {w: n * idf[w] for w, n in c.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        unit[k] = {w: x / length for w, x in v.items()}
    return idf, other, unit


def anchors(unit: dict[str, dict[str, float]], at_least: float) -> list[str]:
    """Words of which every line at a cosine of at_least or more to a template has one."""
    out = set()
    for v in unit.values():
        mass = 0.0
        for w, x in sorted(v.items(), key=lambda p: (p[1], p[0])):
            mass += x * x
            if math.sqrt(mass) >= at_least:
                out.add(w)
    return sorted(out)


def _number(x: float) -> Column:
    return F.lit(float(x))


def _among(words) -> Callable[[Column], Column]:
    return lambda w: w.isin(sorted(words))


def _by_word(unit: dict[str, dict[str, float]]) -> Column:
    """Each word's weight in every form, as a map that folds into one literal."""
    words = sorted({w for v in unit.values() for w in v})
    return F.expr("map(" + ", ".join(f"'{w}', array({', '.join(f'{v.get(w, 0.0)!r}D' for v in unit.values())})" for w in words) + ")")


def _sums(terms: Column, n: int, part: Column, each: Callable[[Column, Column], Column], word: Callable[[Column], Column]) -> Column:
    """For every form the sum of each(term, the word's weight in it)."""
    return F.aggregate(terms, F.array_repeat(F.lit(0.0), n), lambda s, t: F.zip_with(s, F.element_at(part, word(t)), lambda x, y: x + each(t, y)))


def _squares(words: Column) -> Column:
    """The sum of the squares of how often each distinct word occurs, from runs of equal words in sorted order."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(s, w):
        run = F.when(s["w"] == w, s["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(w.alias("w"), (run + 1).alias("run"), (s["sum"] + 2 * run + 1).alias("sum"))

    return F.aggregate(F.array_sort(words), start, step)["sum"]


def _words(part: Column) -> Column:
    """The words of a plain part that have weight."""
    return F.filter(F.split(part, " "), lambda w: ~w.isin(["", *STOP]))


def _plain(text: Column) -> Column:
    """A text of lower-case words, blanks and line ends."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9\n]+", " "))


def _reaches(known: Column, others: Column, at_least: float, other: float) -> Column:
    """Whether known words of that total weight can be a share of at_least beside so many other words."""
    return known * math.sqrt(1 - at_least * at_least) >= (at_least - 1e-6) * other * F.sqrt(others)


def _parts(rows: DataFrame, idf: dict[str, float], other: float, at_least: float) -> DataFrame:
    """rows(uid, is_licence, text) -> (uid, part): the lines, windows of lines, paragraphs and, of a licence file, whole texts that can reach at_least."""
    rare = F.create_map(*[c for w, x in sorted(idf.items()) for c in (F.lit(w), _number(x))])
    known = lambda words: F.filter(words, _among(idf))
    weight = lambda words: F.aggregate(known(words), F.lit(0.0), lambda s, w: s + F.element_at(rare, w))

    def weighed(part: Column) -> Column:
        return F.struct(part.alias("t"), weight(_words(part)).alias("k"), (F.size(_words(part)) - F.size(known(_words(part)))).alias("o"))

    # explode of one value: the expressions that follow read it instead of computing it again
    rows = rows.select("uid", "is_licence", F.explode(F.array(_plain(F.col("text")))).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    blocks = F.concat(F.split("text", "\n *\n"), F.when(F.col("is_licence"), F.array("text")).otherwise(F.array().cast("array<string>")))
    blocks = F.transform(blocks, lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))
    rows = rows.select("uid", F.explode(F.array(F.struct(F.transform(lines, weighed).alias("lines"), F.transform(blocks, weighed).alias("blocks")))).alias("p")).select("uid", "p.lines", "p.blocks")
    n = F.size("lines")

    def window(k: int) -> Column:
        last = F.greatest(n - k + 1, F.lit(1))
        total = lambda i, f: F.aggregate(F.slice("lines", i, k), F.lit(0).cast("double"), lambda s, x: s + x[f])
        starts = F.filter(F.sequence(F.lit(1), last), lambda i: _reaches(total(i, "k"), total(i, "o"), at_least, other))
        return F.transform(starts, lambda i: F.array_join(F.transform(F.slice("lines", i, k), lambda x: x["t"]), " "))

    whole = F.transform(F.filter("blocks", lambda x: _reaches(x["k"], x["o"], at_least, other)), lambda x: x["t"])
    return rows.select("uid", F.explode(F.array_distinct(F.concat(*[window(k) for k in (1, *WINDOWS)], whole))).alias("part"))


def own_licence(files: DataFrame, at_least: float, templates: dict[str, str]) -> DataFrame:
    """files(uid, is_licence, text) -> (uid, own, own_score) of the files with a part that reaches at_least; ties go to the first name.

    What follows a # in a template's key tells a licence's forms apart.
    """
    idf, other, unit = weights(templates)
    names, part = [k.split("#")[0] for k in unit], _by_word(unit)
    rare = F.create_map(*[c for w, x in sorted(idf.items()) for c in (F.lit(w), _number(x))])
    lines = _parts(files, idf, other, at_least).select("uid", F.explode(F.array(_words(F.col("part")))).alias("words"))
    lines = lines.where(F.exists("words", _among(anchors(unit, at_least))))
    lines = lines.select("uid", "words", F.explode(F.array(F.filter("words", _among(idf)))).alias("known"))
    terms = F.transform(F.array_distinct("known"), lambda w: F.struct(w.alias("w"), ((F.size("known") - F.size(F.array_remove("known", w))) * F.element_at(rare, w)).alias("x")))
    lines = lines.select("uid", "words", (F.size("words") - F.size("known")).alias("n_other"), F.explode(F.array(terms)).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, t: s + t["x"] * t["x"])
    # the other words weigh the least if each occurs once: a part whose share of known words is too small even then cannot reach at_least
    lines = lines.where(F.sqrt(square) >= (at_least - 1e-6) * F.sqrt(square + other * other * F.col("n_other")))
    norm = F.sqrt(square + other * other * _squares(F.filter("words", lambda w: ~_among(idf)(w))))
    lines = lines.select("uid", norm.alias("norm"), _sums(F.col("v"), len(unit), part, lambda t, y: t["x"] * y, lambda t: t["w"]).alias("dots"))
    scored = F.zip_with("dots", F.split(F.lit("#".join(names)), "#"), lambda d, name: F.struct(F.round(d / F.col("norm"), 6).alias("score"), name.alias("name")))
    each = lines.select("uid", F.explode(scored).alias("s")).where(F.col("s.score") >= at_least)
    best = each.groupBy("uid").agg(F.max("s.score").alias("own_score"), F.min(F.struct(-F.col("s.score"), F.col("s.name").alias("name"))).alias("b"))
    return best.select("uid", F.col("b.name").alias("own"), "own_score")


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, is_licence: Column, at_least: float = 0.6, templates: dict[str, str] | None = None) -> DataFrame:
    """(id_col, path_col, own, own_score, licence, origin): each file's own licence, and the one that holds for it.

    The licence in force is the file's own; else that of the nearest directory, its own or one above, with a licence file
    (a row that is_licence marks and that has a licence; of several in a directory the best score, then the first name); else null.
    origin is own, inherited or none. Null and empty texts have no licence, a null path no directory. Each row is a file of its own, whatever its id,
    so repeated rows get a row each; an empty table gives none; other columns are ignored. A very long text is read whole; only those of its windows are
    built that can reach at_least.
    """
    forms = templates or NOTICES
    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"), F.coalesce(is_licence, F.lit(False)).alias("is_licence"))
    rows = rows.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))))
    words = F.split(F.regexp_replace(F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")), "^ | $", ""), " ")
    anchor = F.arrays_overlap(words, F.split(F.lit(" ".join(anchors(weights(forms)[2], at_least))), " "))
    # the one pass over the texts: those without an anchor are not needed again
    rows = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "path", "dir", "is_licence", F.when(anchor, F.col("text")).alias("text")), "licence-rows")
    own = own_licence(rows.where("text is not null").select("uid", "is_licence", "text"), at_least, forms)
    skinny = rows.select("uid", "id", "path", "dir", "is_licence").join(own, "uid", "left")
    lenders = skinny.where("is_licence and own is not null and dir is not null").groupBy("dir").agg(F.min(F.struct(-F.col("own_score"), F.col("own"))).alias("b")).select(F.col("dir").alias("above"), F.col("b.own").alias("lent"))
    dirs = rows.where("dir is not null").select("dir").distinct()
    depth = F.size(F.split("dir", "/"))
    chain = dirs.select("dir", F.explode(F.sequence(F.lit(0), depth)).alias("depth")).select("dir", "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("substring_index(dir, '/', depth)")).alias("above"))
    nearest = chain.join(lenders, "above").groupBy("dir").agg(F.max(F.struct("depth", "lent")).alias("n")).select("dir", F.col("n.lent").alias("lent"))
    out = skinny.join(nearest, "dir", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("lent").isNotNull(), "inherited").otherwise("none")
    return out.select(F.col("id").alias(id_col), F.col("path").alias(path_col), "own", "own_score", F.coalesce("own", "lent").alias("licence"), origin.alias("origin"))
