"""Licences inside documents, not only documents that are one."""

from loomline.llm import licenses
from loomline.llm._license_texts import KNOWN, all_known


def test_segments(spark):
    every = all_known()
    wrapped = "\n".join(" * " + " ".join(KNOWN["BSD-3-Clause-untitled"].split()[i : i + 7]) for i in range(0, 300, 7))
    texts = {
        1: "Some prose.\nThis work is licensed under the GNU General Public License, version 3.\nMore prose.",
        2: "Some prose.\nLicensed under CC BY-NC 4.0.",
        3: "Released under the MIT License.\nprose",
        4: "prose\n\nThe MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n" + KNOWN["MIT-untitled"],
        5: "prose before\n" + every["GPL-3.0"] + "\nprose after",
        6: "/*\n * Copyright (c) 2020, Somebody\n * All rights reserved.\n *\n" + wrapped + "\n */\nint main() {}",
        7: "prose, all of it",
        8: "All rights reserved.",
        9: None,
        10: "",
        11: "# SPDX-License-Identifier: GPL-2.0-or-later\nimport os",
    }
    got = {r.id: r for r in licenses.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = {1: "GPL-3-line", 2: "CC-BY-NC-4.0-line", 3: "MIT-line", 4: "MIT-titled", 5: "GPL-3.0", 6: "BSD-3-Clause-untitled", 7: None, 8: "All-rights-reserved", 9: None, 10: None, 11: "SPDX-GPL-2.0-or-later"}
    assert {i: r.license_id for i, r in got.items()} == want
    assert "All-rights-reserved" in got[6].licenses and got[7].licenses == [] and got[9].digest is None
    ids = list(every)
    alone = licenses.scan_licenses(spark.createDataFrame([(i, every[k]) for i, k in enumerate(ids)], "doc_id long, text string")).collect()
    assert all(ids[r.id] in r.licenses or r.license_id for r in alone)
