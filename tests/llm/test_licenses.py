import regex

from voxelgrain.llm import licenses as l


def grams(text):
    w = regex.sub(r"[^\p{L}\p{M}0-9]+", " ", text.lower()).strip(" ").split(" ")
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


def brute(rows):
    segments, out = {}, {}
    for key, text in rows:
        paragraphs = regex.split(r"\n[\x20\x09-\x0D]*\n", text or "")
        for s in {*(text or "").split("\n"), *(p for p in paragraphs if "\n" in p), *([text] if len(paragraphs) > 1 else [])}:
            for x in [s, *regex.split(l.SENTENCE_END, s)]:
                segments.setdefault(key, set()).add(" ".join(regex.findall(r"[\p{L}\p{M}0-9]+", x.lower())))
    numbers = lambda x: set(regex.findall(r"(?<!\S)[0-9]+(?!\S)", x))
    for key, found in segments.items():
        for s in found:
            fits = []
            for spdx, notice in l.TEMPLATES:
                a, b = grams(s), grams(notice)
                if a and 200 * len(a & b) >= l.PERCENT * (len(a) + len(b)):
                    fits.append((-2 * len(a & b) / (len(a) + len(b)), len(numbers(s) ^ numbers(regex.sub(r"[^\p{L}\p{M}0-9]+", " ", notice.lower()))), spdx))
            if fits:
                less, _, spdx = min(fits)
                best, n = out.get((key, spdx), (0, 0))
                out[key, spdx] = (max(best, round(-less, 6)), n + 1)
    return out


def test_against_brute_force(spark):
    notices = [t for _, t in l.TEMPLATES]
    rows = [(i, f"Some words before.\n{t}\nand some after it") for i, t in enumerate(notices)]
    rows += [(100 + i, t.upper().replace(" ", "\n", 3).replace("License", "Licence", 1)) for i, t in enumerate(notices)]
    rows += [(200 + i, f"para one\nmore of it\n \t\n{t[: len(t) // 2]}\n{t[len(t) // 2 :]}\n\nlast") for i, t in enumerate(notices)]
    rows += [(300, None), (301, ""), (302, "one"), (303, "x " * 50000), (304, "Released under the MIT License." * 3), (305, "\n\n\n"), (None, notices[0]), (306, "Licença é ñ. " + notices[0])]
    rows += [(307, " ".join(notices[4:6])), (307, notices[0])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, grams int")
    got = {(r.doc_id, r.license): (r.dice, r.n_segments) for r in l.scan(df).collect()}
    assert got == brute(rows)
    assert all((i, spdx) in got for i, (spdx, _) in enumerate(l.TEMPLATES))
    assert l.scan(df.limit(0)).count() == 0


def test_one_licence_by_line_and_versions_apart(spark):
    rows = [
        (1, "Licensed under the GNU General Public License, version 3."), (2, "Licensed under the GNU General Public License, version 2."),
        (3, "Some words on the page. Released under the MIT License. More words that follow, and many of them at that."),
        (4, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ]
    got = {(r.doc_id, r.license) for r in l.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "GPL-3.0"), (2, "GPL-2.0"), (3, "MIT"), (4, "GPL-2.0")}
