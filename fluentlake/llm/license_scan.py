"""Op 4 [native]: licence scans by sparse TF-IDF cosine and inheritance from the nearest ancestor directory.

Every line of a file that has a licence word is compared with the templates: cosine of TF-IDF vectors, with document
frequencies over the templates (a word of no template has the greatest weight and counts in the line's length only). A
file has the template of its best line at `least` or more. A licence file (by its name, or because it consists of nothing
but licence lines) also gives its licence to its directory; files without one of their own inherit that of the nearest
ancestor directory, by equi-joins on directory paths.

All is DataFrame code. Lines are handled inside their row (higher-order functions), so nothing is shuffled until each file
is one short row; these rows are written once, as they are read three times. Inheritance is worked out per distinct directory, whose rows are counted before the shuffle, and joined
back with salted directories, so a directory with a third of all files is spread.

Whole texts, comment headers and paragraphs of a file with a licence word are compared in the same way with the texts of
licences, standard headers and titles (`BLOCKS`), at `least_block` or more. A whole text goes before a header or paragraph,
and both before a line; a file that is a licence text as a whole is a licence file. The table of all words of these texts is
an array of buckets by crc32, read once per plan as a constant.

Null and empty texts have no licence line. A null path is the root directory. Ties go to the first template by name.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluentlake.llm.shared import ascii_lower, stored

#: Short statements of common licences, as headers and licence files put them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
}
#: Titles and SPDX forms of a licence, each a line.
LINES = {name: (text, f"SPDX-License-Identifier: {name}") for name, text in TEMPLATES.items()}
LINES["MIT"] += ("MIT License", "The MIT License (MIT)")
LINES["GPL-3.0"] += ("SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later")
LINES["GPL-2.0"] = ("SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later")
LINES["LGPL-2.1"] = ("SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later")
LINES["LGPL-3.0"] = ("SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later")
LINES |= {name: (f"SPDX-License-Identifier: {name}",) for name in ("BSD-2-Clause", "CC0-1.0", "MPL-1.1")}
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this {0}. If not, see <https://www.gnu.org/licenses/>."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_END = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
#: Standard headers and titles of more than a line.
HEADERS = {
    "Apache-2.0": (_APACHE, f"{_APACHE} {_APACHE_END}", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    "GPL-2.0": (_GNU.format("program", "General Public License", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    "GPL-3.0": (_GNU.format("program", "General Public License", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "LGPL-2.1": (_GNU.format("library", "Lesser General Public License", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    "LGPL-3.0": (_GNU.format("library", "Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
}
#: Texts of whole licences, one file each.
TEXTS = {x.stem: (x.read_text(),) for x in sorted((Path(__file__).parent / "licences").glob("*.txt"))}
BLOCKS = {name: TEXTS.get(name, ()) + HEADERS.get(name, ()) for name in sorted({*TEXTS, *HEADERS})}
LEAST_BLOCK = 0.85
BUCKETS = 4096
#: A line without any of these is not compared.
MARKERS = "licen[cs]|copyright|permission|redistribut"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying)[^/]*$"
LEAST = 0.7
SALTS = 16


def terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9.+-]*[a-z0-9]", text.lower())


def template_vectors(templates: dict[str, str | tuple[str, ...]]) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Weights of the templates' words, the weight of any other word, and names and unit vectors of the templates."""
    texts = [(name, text) for name, held in sorted(templates.items()) for text in ((held,) if isinstance(held, str) else held)]
    n = len(texts)
    seen = Counter(w for _, text in texts for w in set(terms(text)))
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in seen.items()}
    vectors = []
    for name, text in texts:
        raw = {w: c * idf[w] for w, c in Counter(terms(text)).items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        vectors.append((name, {w: x / length for w, x in sorted(raw.items())}))
    return idf, math.log(1 + n) + 1, vectors


def let(value: Column, body) -> Column:
    """body(value), with value worked out once inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


def _word_table(idf: dict[str, float], vectors: list[tuple[str, dict[str, float]]]) -> Column:
    """BUCKETS arrays by crc32 of the word, of structs: w, idf, and v, its weight in each template."""
    table: list[list] = [[] for _ in range(BUCKETS)]
    for w, x in sorted(idf.items()):
        table[zlib.crc32(w.encode()) % BUCKETS].append({"w": w, "idf": x, "v": [v.get(w, 0.0) for _, v in vectors]})
    return F.from_json(F.lit(json.dumps(table)), "array<array<struct<w:string,idf:double,v:array<double>>>>")


def counted(words: Column) -> Column:
    """Structs of each distinct word (w) and its count (n), in time of a sort."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("w"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("double").alias("n"))))

    return let(F.sort_array(words), runs)


def line_match(line: Column, templates: dict[str, str | tuple[str, ...]]) -> Column:
    """struct(score, name) of the template closest to a line or block; the first by name on a tie. Null without words."""
    idf, unknown, vectors = template_vectors(templates)
    table = _word_table(idf, vectors)

    def known(w: Column) -> Column:
        return F.get(F.filter(F.get(table, (F.crc32(w.cast("binary")) % BUCKETS).cast("int")), lambda e: e["w"] == w), F.lit(0))

    def closest(weighted: Column) -> Column:
        length = F.sqrt(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + F.pow(x["n"] * F.coalesce(x["e"]["idf"], F.lit(unknown)), F.lit(2.0))))
        dots = F.aggregate(F.filter(weighted, lambda x: x["e"].isNotNull()), F.array_repeat(F.lit(0.0), len(vectors)), lambda a, x: F.zip_with(a, x["e"]["v"], lambda y, v: y + x["n"] * x["e"]["idf"] * v))
        best = F.array_max(F.transform(dots, lambda d, k: F.struct((d / length).alias("score"), (-k).alias("rank"))))
        names = F.array(*[F.lit(name) for name, _ in vectors])
        return let(best, lambda s: F.struct(s["score"].alias("score"), F.element_at(names, 1 - s["rank"]).alias("name")))

    words = F.regexp_extract_all(ascii_lower(line), F.lit(r"([a-z0-9.+-]*[a-z0-9])"), F.lit(1))
    weigh = lambda w: F.transform(counted(w), lambda x: F.struct(x["n"].alias("n"), known(x["w"]).alias("e")))
    return let(words, lambda w: F.when(F.size(w) > 0, let(weigh(w), closest)))


def blocks(text: Column) -> Column:
    """Leading comments and paragraphs with a licence word."""
    lines = F.split(text, "\n")
    code = F.array_position(F.transform(lines, lambda x: F.regexp_like(x, F.lit(r"^\s*(#|//|/\*|\*|--|;|%|<!--)"))), False)
    header = F.array_join(F.slice(lines, 1, F.greatest(code - 1, F.lit(0)).cast("int")), "\n")
    boxed = F.regexp_extract(text, r"(?s)^\s*/\*(.*?)\*/", 1)
    return F.filter(F.concat(F.array(header, boxed), F.split(text, r"\n[ \t\r]*\n")), lambda x: F.regexp_like(ascii_lower(x), F.lit(MARKERS)))


def parents(directory: Column) -> Column:
    """A directory and its ancestors, the root ("") last."""
    parts = F.split(directory, "/")
    depth = F.when(directory == "", F.lit(0)).otherwise(F.size(parts))
    above = F.transform(F.sequence(F.lit(0), depth), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    return F.reverse(above)


def scan_licences(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, str | tuple[str, ...]] = LINES, least: float = LEAST, keep: tuple[str, ...] = (), block_templates: dict[str, tuple[str, ...]] = BLOCKS, least_block: float = LEAST_BLOCK) -> DataFrame:
    """One row per file: path, own_licence, own_score, n_licence_lines, licence, licence_dir (null if its own), and keep."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.trim(x)) > 0)
    likely = F.filter(lines, lambda x: F.regexp_like(ascii_lower(x), F.lit(MARKERS)))
    name = F.coalesce(F.col(path), F.lit(""))
    carried = [F.col(c).alias(f"_kept_{k}") for k, c in enumerate(keep)]
    read = files.select(name.alias("path"), *carried, F.size(lines).alias("n_lines"), likely.alias("likely"), F.when(F.size(likely) > 0, body).alias("body"))
    matched = read.select("*", F.filter(F.transform("likely", lambda x: line_match(x, templates)), lambda m: F.coalesce(m["score"] >= least, F.lit(False))).alias("found"))
    nothing = F.struct(F.lit(-1.0).alias("score"), F.lit(None).cast("string").alias("name"))
    best = lambda found: F.aggregate(found, nothing, lambda a, m: F.when(m["score"] > a["score"], m).otherwise(a))
    near = lambda texts: F.filter(F.transform(texts, lambda x: line_match(x, block_templates)), lambda m: F.coalesce(m["score"] >= least_block, F.lit(False)))
    compared = matched.withColumn("whole", F.when(F.col("body").isNotNull(), best(near(F.array("body"))))).withColumn("block", F.when(F.col("whole.score") < 0, best(near(blocks(F.col("body"))))))
    is_text = F.coalesce(F.col("whole.score") >= 0, F.lit(False))
    chosen = F.when(is_text, F.col("whole")).when(F.coalesce(F.col("block.score") >= 0, F.lit(False)), F.col("block")).otherwise(best("found"))
    told = compared.withColumn("best", chosen).withColumn("has", F.col("best.score") >= 0)
    own = stored(told.select(
        "path", *[f"_kept_{k}" for k in range(len(keep))], F.col("best.name").alias("own_licence"), F.when(F.col("has"), F.col("best.score")).alias("own_score"), F.size("found").alias("n_licence_lines"),
        F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), "has",
        (F.col("has") & (is_text | F.col("path").rlike(LICENCE_FILE) | ((F.size("found") > 0) & (F.size("found") == F.col("n_lines"))))).alias("gives"),
    ), "licences")
    givers = own.where("gives").groupBy("dir").agg(F.min(F.struct(-F.col("own_score"), "own_licence", "path")).alias("best")).select(F.col("dir").alias("given_dir"), F.col("best.own_licence").alias("given"))
    wanted = own.where("not has").select("dir").distinct().withColumn("above", F.explode(parents(F.col("dir"))))
    nearest = wanted.join(givers, F.col("above.dir") == F.col("given_dir")).groupBy("dir").agg(F.max(F.struct("above.depth", "given_dir", "given")).alias("near"))
    salted = nearest.select(F.col("dir").alias("_dir"), "near.given_dir", "near.given", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt"))
    salt = F.pmod(F.xxhash64("path", *[f"_kept_{k}" for k in range(len(keep))]), F.lit(SALTS)).cast("int")
    joined = own.withColumn("salt", salt).join(salted, (F.col("dir") == F.col("_dir")) & (F.col("salt") == F.col("_salt")) & ~F.col("has"), "left")
    return joined.select("path", "own_licence", F.round("own_score", 6).alias("own_score"), F.col("n_licence_lines").cast("long").alias("n_licence_lines"), F.coalesce("own_licence", "given").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("given_dir")).alias("licence_dir"), *[F.col(f"_kept_{k}").alias(c) for k, c in enumerate(keep)])
