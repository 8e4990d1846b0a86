"""License scan: TF-IDF cosine of lines, sentences, windows and licence files to templates, then inheritance from the nearest directory.

Document frequencies of the templates' words are counted over all files. A
file's lines, its sentences, its windows as long as a template (so headers may
be wrapped) and, for files named as licences, its whole text are compared with
the templates as sparse TF-IDF vectors; words outside the templates weigh as
words that no other file has. Neighbouring licences, whose notices differ in a
word or two, are told apart by the words that name them. A file without a
licence of its own takes that of the nearest directory above it that holds a
licence file: directories are joined with their ancestors by path.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Notices by SPDX identifier (fixed values).
NOTICES = {
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",
                 "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",
                "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-3.0": ("Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-SA-3.0": ("Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "ISC": ("Released under the ISC License.", "Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1.",
                 "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",
                 "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}
#: Every licence's notices and its tag.
TEMPLATES = {name: (*notices, f"SPDX-License-Identifier: {name}") for name, notices in NOTICES.items()}
#: Words that name a licence; a text without one that a notice has isn't that notice, nor one without its numbers (fixed values).
NAMING = frozenset("apache mit gnu lesser affero mozilla bsd 0bsd isc boost cc creative by nc noncommercial sa sharealike nd noderivatives gpl lgpl agpl mpl bsl spdx endorse".split())
#: Words that make it another licence, and words that deny it: a text with one that a notice lacks isn't that notice (fixed values).
VARIANTS = frozenset("lesser affero nc noncommercial commercial sa sharealike alike nd noderivatives noderivs derivatives lgpl agpl endorse".split())
DENIALS = frozenset("not never no cannot isn aren wasn weren".split())
#: Words before a window, of the same sentence, in which a denial counts.
BEFORE = 3
#: The best licence must lead every other that its words allow by so much.
MARGIN = 0.01
#: Names of licence files, without extension.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
WORDS = re.compile(r"\d+(?:\.\d+)+|\w+")
#: Words that mark a comment line; other marks aren't words.
COMMENT = re.compile(r"\W*(?:rem|dnl|c)(?=\s)", re.I)
SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+")


def words(line: str) -> list[str]:
    return WORDS.findall(line.lower())


def vocabulary() -> set[str]:
    return {w for notices in TEMPLATES.values() for n in notices for w in words(n)}


def idf_weights(files: DataFrame) -> tuple[dict[str, float], float]:
    """idf of each template word over all files, and of a word that none has; only the vocabulary reaches the driver."""
    vocab = vocabulary()

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        seen, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                seen.update(vocab.intersection(words(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(["", *seen]), pa.array([n, *seen.values()], pa.int64())], ["word", "df"])

    df = dict(files.select("text").mapInArrow(run, "word string, df long").groupBy("word").agg(F.sum("df")).collect())
    n = df.pop("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocab}, math.log(n + 1) + 1


class Matcher:
    """Cosines of a text's TF-IDF vector to the templates' vectors, and which templates a text's words allow."""

    def __init__(self, idf: dict[str, float], unseen: float):
        from collections import Counter

        self.idf, self.unseen, self.post = idf, unseen, {}
        self.names, self.sizes, self.gains, self.need, self.bar = [], [], [], [], []
        for name in sorted(TEMPLATES):
            for notice in TEMPLATES[name]:
                tf = Counter(words(notice))
                norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
                for w, c in tf.items():
                    self.post.setdefault(w, []).append((len(self.names), c * idf[w] / norm))
                self.gains.append({w: c * idf[w] / norm for w, c in tf.items()})
                self.sizes.append(sum(tf.values()))
                self.names.append(name)
                self.need.append({w for w in tf if w in NAMING or w[0].isdigit()})
                self.bar.append((VARIANTS | DENIALS) - set(tf))

    def best(self, found: list[str]) -> tuple[str | None, float]:
        """The licence of the best allowed template, if it leads those of other licences by the margin, and its cosine; else None and the best cosine."""
        from collections import Counter

        tf = Counter(found)
        shared = [w for w in tf if w in self.post]
        if len(shared) < 2:
            return None, 0.0
        dots = [0.0] * len(self.names)
        for w in shared:
            weight = tf[w] * self.idf[w]
            for t, x in self.post[w]:
                dots[t] += weight * x
        norm = math.sqrt(sum((c * self.idf.get(w, self.unseen)) ** 2 for w, c in tf.items()))
        own = set(shared)
        fit = [t for t in range(len(dots)) if self.need[t] <= own and not any(w in tf for w in self.bar[t])]
        if fit:
            k = max(fit, key=lambda t: (dots[t], -t))
            rival = max((dots[t] for t in fit if self.names[t] != self.names[k]), default=-1.0)
            if dots[k] - rival >= MARGIN * norm:
                return self.names[k], dots[k] / norm
        return None, max(dots) / norm

    def windows(self, lines: list[str], found: list[list[str]], least: float) -> tuple[str | None, float]:
        """The best window of at least ``least``: lines, sentences, adjacent lines and sentences about as long as a template,
        and any as many words as a template has. found: the words of each line.

        No cosine is over the length of the template's part whose words the
        text has, nor over the dot product by the window's length if no word
        repeated; only windows that these bounds allow are compared. A window
        after a denial in its sentence doesn't count.
        """
        import numpy as np

        shared = {w for line in found for w in line if w in self.post}
        likely = [k for k, g in enumerate(self.gains) if self.need[k] <= shared and sum(x * x for w, x in g.items() if w in shared) >= least * least - 1e-9]
        if not likely:
            return None, 0.0
        flow, units, sentences, rows = [], [0], [0], [0]
        for line, own in zip(lines, found):
            if not own:  # a paragraph ends
                sentences.append(len(flow))
                continue
            mark = COMMENT.match(line)
            pieces = SENTENCE_END.split(line[mark.end():] if mark else line)
            for i, piece in enumerate(pieces):
                flow += words(piece)
                units.append(len(flow))
                if i + 1 < len(pieces) or piece.rstrip("\"')]*/ \t-").endswith((".", "!", "?")):
                    sentences.append(len(flow))
            rows.append(len(flow))
        units, sentences, rows, n = np.unique(units), np.unique([*sentences, len(flow)]), np.unique(rows), len(flow)
        length = np.concatenate([[0], np.cumsum([self.idf.get(w, self.unseen) ** 2 for w in flow])])
        chosen = set()
        for k in likely:
            size = self.sizes[k]
            dot = np.concatenate([[0], np.cumsum([self.gains[k].get(w, 0.0) * self.idf.get(w, 0.0) for w in flow])])
            over = np.minimum(np.searchsorted(units, units[:-1] + size), len(units) - 1)
            under = np.maximum(np.searchsorted(units, units[:-1] + size, side="right") - 1, np.arange(1, len(units)))
            pairs = [(units[:-1], units[1:]), (sentences[:-1], sentences[1:]), (rows[:-1], rows[1:]), (units[:-1], units[over]), (units[:-1], units[under])]
            if n >= size:
                pairs.append((np.arange(n - size + 1), np.arange(size, n + 1)))
            for a, b in pairs:
                can = (b > a) & (dot[b] - dot[a] >= (least - 1e-9) * np.sqrt(np.maximum(length[b] - length[a], 0)) - 1e-9)
                chosen.update(zip(a[can].tolist(), b[can].tolist()))
        top = (None, 0.0)
        for a, b in sorted(chosen):
            now = self.best(flow[a:b])
            if now[0] and now[1] >= least and now[1] > top[1] + 1e-12:
                start = int(sentences[np.searchsorted(sentences, a, side="right") - 1])
                if DENIALS.isdisjoint(flow[max(start, a - BEFORE):a]):
                    top = now
        return top


def declared(files: DataFrame, header_least: float = 0.8, file_least: float = 0.5) -> DataFrame:
    """(id, path, licence_file, license, score) by each file's own text; no licence: null and the best cosine.

    A header needs a cosine of ``header_least`` in one of its lines, sentences
    or windows of adjacent words as long as a template; a licence file's whole
    text needs ``file_least``. Whatever the cosine, a text is no notice of a
    licence whose name or version it lacks, whose variant it names or that it
    denies, and none where two licences are as near. Without a licence the
    score is the best line's. Equal cosines go to the licence first by name.
    """
    idf, unseen = idf_weights(files)

    def run(batches):
        import pyarrow as pa

        match, named = Matcher(idf, unseen), re.compile(LICENCE_FILE).match
        for batch in batches:
            out = []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text or ""
                own = bool(named((path or "").rpartition("/")[2]))
                lines = text.splitlines()
                split = [words(line) for line in lines]
                name, score = match.windows(lines, split, header_least)
                if own and not name:
                    whole = match.best([w for line in split for w in line])
                    name, score = whole if whole[1] >= file_least else (None, 0.0)
                if not name:
                    score = max([score, *(match.best(line)[1] for line in split)])
                out.append((own, name, score))
            own, name, score = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.bool_()), pa.array(name, pa.string()), pa.array(score, pa.float64())], ["id", "path", "licence_file", "license", "score"])

    return files.select("id", "path", "text").mapInArrow(run, f"id {files.schema['id'].dataType.simpleString()}, path string, licence_file boolean, license string, score double")


def parent(path: str):
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan(files: DataFrame, header_least: float = 0.8, file_least: float = 0.5) -> DataFrame:
    """One row per file (id, path, text): id, path, license, score, how, license_dir.

    how is "file" (the licence file itself), "header" or "inherited" (with the
    directory it comes from), or null without a licence. Of several licence
    files in one directory the best match counts, then the first by path. Null
    paths belong to no directory; null and empty texts declare nothing. Files
    may repeat; other columns are ignored.
    """
    files = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = materialize(declared(files, header_least, file_least), "declared")
    rank = F.struct((-F.col("score")).alias("s"), "path", "license")
    held = own.where("licence_file and license is not null").groupBy(parent("path").alias("license_dir")).agg(F.min(rank).alias("r"))
    held = materialize(held.select("license_dir", F.col("r.license").alias("dir_license")), "held")
    dirs = own.where("license is null and path is not null").select(parent("path").alias("dir")).distinct()
    steps = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.split("dir", "/"), 1, k), "/").alias("license_dir")))
    above = dirs.select("dir", F.explode(steps).alias("a")).select("dir", "a.depth", "a.license_dir").join(held, "license_dir")
    nearest = materialize(above.groupBy("dir").agg(F.max_by(F.struct("license_dir", "dir_license"), "depth").alias("n")), "nearest")
    found = own.withColumn("dir", F.when(F.col("license").isNull(), parent("path"))).join(nearest, "dir", "left")
    how = F.when(F.col("license").isNotNull(), F.when(F.col("licence_file"), "file").otherwise("header")).when(F.col("n").isNotNull(), "inherited")
    return found.select("id", "path", F.coalesce("license", "n.dir_license").alias("license"), "score", how.alias("how"), F.col("n.license_dir").alias("license_dir"))
