"""License scan by a positional rare-token index.

The index holds, for every licence template, its postings: word -> (template,
position). One pass over the corpus counts in how many documents each licence
word occurs, which gives the words' IDF. The second pass takes each file's
highest-IDF licence words, those at or above a bar that leaves every template's
first key phrase a word, looks them up in the template postings and subtracts
template positions from file positions. The starts that votes agree on are
verified word by word against the template's mandatory key phrases. Both passes
are row-local array expressions; the only exchange carries one count per licence
word.

A bare phrase is a template whose mandatory phrase is all of it: no place of one
is missed.

Null and empty texts have no words, no places and no labels; score 0. Repeated
rows are scanned each for itself; a long text is scanned whole. Of several starts
of a notice the best counts, ties give the same score. Extra columns pass
through untouched, unless an output column has the same name: then the output
wins. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import NOT_ALNUM, ascii_lower, indices, let, words

# Phrases and labels every scan finds.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Licence texts and notices (label, text, mandatory key phrases).
_AS_IS = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
    "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_HEAD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution"
)
_GNU = (
    "this program is free software you can redistribute it and or modify it under the terms of the {0} as published by the free software foundation "
    "either version {1} of the license or at your option any later version this program is distributed in the hope that it will be useful but without "
    "any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {0} for more details"
)
_ISC = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
NOTICES = (
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
        "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
        "the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this "
        f"permission notice shall be included in all copies or substantial portions of the software {_AS_IS}",
        ("permission is hereby granted free of charge", "the software without restriction"),
    ),
    ("bsd", _BSD_HEAD, ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    ("bsd-3", f"{_BSD_HEAD} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "may be used to endorse or promote products")),
    ("isc", _ISC, ("permission to use copy modify", "is hereby granted")),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the "
        "license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is "
        "distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing "
        "permissions and limitations under the license",
        ("apache license version 2 0", "in compliance with the license"),
    ),
    ("gpl-2.0-text", _GNU.format("gnu general public license", 2), ("free software foundation", "either version 2 of the license")),
    ("gpl-3.0-text", _GNU.format("gnu general public license", 3), ("free software foundation", "either version 3 of the license")),
    ("lgpl-text", _GNU.format("gnu lesser general public license", 3), ("gnu lesser general public license", "free software foundation")),
    ("agpl-text", _GNU.format("gnu affero general public license", 3), ("gnu affero general public license", "free software foundation")),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ("mozilla public license",),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of "
        "this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it "
        "freely subject to the following restrictions the origin of this software must not be misrepresented",
        ("permission is granted to anyone to use this software", "must not be misrepresented"),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software",),
    ),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide under cc0", ("cc0",)),
    # openings, which also stand without the rest
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge", "copy of this software")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc0", "dedicated to the public domain under cc0", ("cc0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    ("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
)


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False
    tokens: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "tokens", tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", self.text)))


def default_templates() -> list[Template]:
    return [Template(label, phrase, (phrase,), True) for phrase, label in BASE_PHRASES] + [Template(*n) for n in NOTICES]


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[dict[str, int], int]:
    """Documents that hold each licence word, and all documents. At most a row per licence word reaches the driver."""
    found = F.filter(words(ascii_lower(F.col(text_col)), NOT_ALNUM), lambda w: w.isin(vocabulary))
    # the empty word stands for the document itself, so one pass gives both figures
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_distinct(found))).alias("w")).groupBy("w").count().collect()
    counts = {r["w"]: r["count"] for r in rows}
    return counts, counts.pop("", 0)


def _at(tokens: tuple[str, ...], phrase: tuple[str, ...]) -> int:
    return next(k for k in range(len(tokens)) if tokens[k : k + len(phrase)] == phrase)


def scan_licenses(
    docs: DataFrame,
    templates: list[Template] | None = None,
    text_col: str = "text",
    slack: int = 3,
    min_score: float = 0.5,
) -> DataFrame:
    """Adds n_words, base_places, n_base, first_word, last_word, base_labels, labels, score.

    ``slack``: how far a vote or a key phrase may stand from its place.
    ``min_score``: the share of its rare words, in place, that a notice needs.
    """
    templates = default_templates() if templates is None else templates
    vocabulary = sorted({w for t in templates for w in t.tokens})
    df, n_docs = document_frequencies(docs, vocabulary, text_col)
    idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}
    lead = lambda t: tuple(t.phrases[0].split())
    # every template's first key phrase has a word at or above the bar, so no place of one is missed
    bar = min((max(idf[w] for w in lead(t)) for t in templates), default=0.0)
    rare = sorted(w for w in vocabulary if idf[w] >= bar)
    index: dict[str, list[tuple[int, int]]] = {w: [] for w in rare}
    for n, t in enumerate(templates):
        for p, w in enumerate(t.tokens):
            if w in index:
                index[w].append((n, p))

    ws = F.col("__words")
    hits = F.transform(
        F.filter(indices(F.size(ws)), lambda i: F.get(ws, i).isin(rare)),
        lambda i: F.struct(F.get(ws, i).alias("w"), i.alias("i")),
    )
    entry = lambda n, p: F.struct(F.lit(n).alias("t"), F.lit(p).alias("p"))
    postings = F.create_map(*(x for w, at in index.items() for x in (F.lit(w), F.array(*(entry(*e) for e in at))))) if rare else None
    vote = lambda h, e: F.struct(e["t"].alias("t"), (h["i"] - e["p"]).alias("s"), e["p"].alias("p"))
    none = F.array().cast("array<int>")
    found = docs.withColumn("__words", words(ascii_lower(F.col(text_col)), NOT_ALNUM)).withColumn("__hits", hits)
    some = F.size("__hits") > 0
    votes = F.flatten(F.transform("__hits", lambda h: F.transform(F.element_at(postings, h["w"]), lambda e: vote(h, e)))) if rare else F.array().cast("array<struct<t:int,s:int,p:int>>")
    found = found.withColumn("__votes", F.when(some, votes))

    def stands(phrase: tuple[str, ...], s: Column) -> Column:
        whole = F.array(*(F.lit(w) for w in phrase))
        return F.when(s >= 0, F.slice(ws, F.greatest(s, F.lit(0)) + 1, F.lit(len(phrase))) == whole).otherwise(False)

    def places(n: int, t: Template) -> Column:
        """Base phrases: the relative positions that votes agree on, verified word by word."""
        starts = F.array_distinct(F.transform(F.filter("__votes", lambda v: v["t"] == n), lambda v: v["s"]))
        return F.array_sort(F.filter(starts, lambda s: stands(t.tokens, s)))

    def score(n: int, t: Template) -> Column:
        """The best share of a notice's rare places that vote for one start, give or take ``slack``; only where all key phrases stand. Null without votes."""
        mine = F.filter("__votes", lambda v: v["t"] == n)
        total = float(sum(w in index for w in t.tokens))
        near = range(-slack, slack + 1)

        def share(x: Column, s: Column) -> Column:
            held = F.size(F.array_distinct(F.transform(F.filter(x, lambda v: F.abs(v["s"] - s) <= slack), lambda v: v["p"]))) / F.lit(total)
            keys = F.lit(True)
            for p in t.phrases:
                phrase = tuple(p.split())
                at = _at(t.tokens, phrase)
                keys = keys & F.exists(F.array(*(F.lit(at + d) for d in near)), lambda d: stands(phrase, s + d))  # noqa: B023
            return F.when(held >= min_score, F.when(keys, held))

        return let(mine, lambda x: F.array_max(F.transform(F.array_distinct(F.transform(x, lambda v: v["s"])), lambda s: share(x, s))))

    base = {n: t for n, t in enumerate(templates) if t.base}
    more = {n: t for n, t in enumerate(templates) if not t.base}
    found = found.withColumns({f"__p{n}": F.when(some, places(n, t)).otherwise(none) for n, t in base.items()})
    found = found.withColumns({f"__s{n}": F.when(some, score(n, t)) for n, t in more.items()})
    has = {n: F.size(f"__p{n}") > 0 for n in base} | {n: F.col(f"__s{n}").isNotNull() for n in more}
    labelled = lambda ts: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(has[n], F.lit(t.label)) for n, t in ts.items()))))), ",") if ts else F.lit("")
    starts = F.array_sort(F.concat(*(F.col(f"__p{n}") for n in base))) if base else none
    found = found.withColumn("base_places", F.when(some, starts).otherwise(none))
    best = F.greatest(F.lit(0.0), F.lit(0.0), *(F.when(has[n], 1.0) for n in base), *(F.col(f"__s{n}") for n in more))
    return found.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "n_base": F.size("base_places").cast("long"),
            "first_word": F.array_min("base_places").cast("long"),
            "last_word": F.array_max("base_places").cast("long"),
            "base_labels": F.when(some, labelled(base)).otherwise(""),
            "labels": F.when(some, labelled(base | more)).otherwise(""),
            "score": F.when(some, best).otherwise(0.0),
        }
    ).drop("__words", "__hits", "__votes", *(f"__p{n}" for n in base), *(f"__s{n}" for n in more))
