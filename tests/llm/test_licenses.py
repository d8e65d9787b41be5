"""License scan: the parser against a recursive evaluation, the automaton against plain search."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarrystone.llm import licenses as L
from quarrystone.llm import queries


@pytest.mark.parametrize(
    ("text", "expression", "kind"),
    [
        ("// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0 */", "( MIT OR GPL-3.0-only ) AND Apache-2.0", "permissive"),
        ("# spdx-license-identifier: GPL-2.0-only WITH Classpath-exception-2.0\ncode", "GPL-2.0-only WITH Classpath-exception-2.0", "weak copyleft"),
        ("# spdx-license-identifier: GPL-2.0-only WITH my-exception-1.0\ncode", "GPL-2.0-only WITH my-exception-1.0", "copyleft"),
        ("SPDX-License-Identifier: MIT OR OR", "MIT", "permissive"),
        ("SPDX-License-Identifier: MIT.", "MIT", "permissive"),
        ("SPDX-License-Identifier: MIT, which is free", "MIT", "permissive"),
        ("SPDX-License-Identifier: Apache-2.0 This file is part of it. All rights reserved", "Apache-2.0", "permissive"),
        ("SPDX-License-Identifier: (MIT OR GPL-2.0 and so on\nISC License", "ISC", "permissive"),
        ("SPDX-License-Identifier: see below\nThe MIT License", "MIT", "permissive"),
        ("SPDX-License-Identifier: see below", "NOASSERTION", "invalid"),
        ("SPDX-License-Identifier:", "NOASSERTION", "invalid"),
        ("SPDX-License-Identifier: ISC\nSPDX-License-Identifier: GPL-3.0+\nSPDX-License-Identifier: ISC", "ISC AND GPL-3.0+", "copyleft"),
        ("SPDX-License-Identifier: My-Own-1.0", "my-own-1.0", "unknown"),
        ("Licensed under the MIT License or the Apache License, Version 2.0.", "MIT OR Apache-2.0", "permissive"),
        ("The MIT License and CC BY-NC 4.0", "MIT AND CC-BY-NC-4.0", "noncommercial"),
        ("MIT License or ISC License\nCC BY-NC 4.0", "(MIT OR ISC) AND CC-BY-NC-4.0", "noncommercial"),
        ("GNU General Public License,\n   version 3 or (at your option) any later version", "GPL-3.0-or-later", "copyleft"),
        ("GNU GPL version 2 with the Classpath exception", "GPL-2.0-only WITH Classpath-exception-2.0", "weak copyleft"),
        ("GNU   General\tPublic License", "LicenseRef-GPL", "copyleft"),
        ("ALL RIGHTS RESERVED", "LicenseRef-All-Rights-Reserved", "proprietary"),
        ("a permit license, commit licenses", None, None),
        ("", None, None),
    ],
)
def test_texts(text, expression, kind):
    found = L.scan(L.automaton(), text)
    assert (found[0], found[2]) == (expression, kind) if found else expression is None


def test_longest_valid_expression():
    """Against the parser: of all beginnings of the tokens, the longest that it accepts."""
    tokens = ["mit", "isc", "and", "or", "with", "(", ")", "classpath-exception-2.0", "the"]
    import itertools

    for n in range(1, 6):
        for chosen in itertools.product(tokens, repeat=n):
            want = None
            for k in range(1, n + 1):
                part = [t.upper() if t in ("and", "or", "with") else t for t in chosen[:k]]
                operands = [(i, t) for i, t in enumerate(part) if t not in ("AND", "OR", "WITH", "(", ")")]
                exceptions = all((i > 0 and part[i - 1] == "WITH") == ("exception" in t) for i, t in operands) if "(" not in part else all((i > 0 and part[i - 1] == "WITH") for i, t in operands if "exception" in t)
                if "the" in part:
                    break
                try:
                    L.to_postfix(" ".join(part))
                except ValueError:
                    continue
                if exceptions and L.evaluate(" ".join(part))[0] != "invalid":
                    want = " ".join(part).replace("mit", "MIT").replace("isc", "ISC").replace("classpath", "Classpath")
            if "exception" in " ".join(chosen) or "with" in chosen:
                continue  # which side of WITH may be what is tested above
            assert L.longest_expression(" ".join(chosen)) == want, chosen


def test_many_tags_in_one_pass():
    import time

    began = time.time()
    found = L.scan(L.automaton(), "SPDX-License-Identifier: MIT\n" * 20_000)
    assert found == ("MIT", ["MIT"], "permissive")
    assert time.time() - began < 5


def _tree():
    leaf = st.sampled_from(["MIT", "GPL-3.0-only", "MPL-2.0", "CC-BY-NC-4.0"])
    return st.recursive(leaf, lambda t: st.tuples(st.sampled_from(["AND", "OR"]), t, t), max_leaves=12)


def _text(t):
    return t if isinstance(t, str) else f"( {_text(t[1])} {t[0]} {_text(t[2])} )"


def _rank(t):
    if isinstance(t, str):
        return L.LICENSES[t.lower()][1]
    return (min if t[0] == "OR" else max)(_rank(t[1]), _rank(t[2]))


@given(_tree())
def test_parser_against_recursion(t):
    assert L.evaluate(_text(t))[0] == L.CLASSES[_rank(t)]


def test_precedence():
    assert L.to_postfix("A OR B AND C WITH D") == ["A", "B", "C", "D", "WITH", "AND", "OR"]
    for bad in ("", "A B", "( A", "A )", "AND A", "A AND ( )", "A WITH"):
        with pytest.raises(ValueError):
            L.to_postfix(bad)


def test_query_against_plain_search(spark, sf):
    got = {r["doc_id"]: set(r["licenses"]) for r in queries.QUERIES["op2_license_scan"](spark, sf).collect()}
    want = {}
    phrases = sorted(L.PHRASES, key=len, reverse=True)
    pattern = re.compile("|".join(rf"(?<!\w){re.escape(p)}(?!\w)" for p in phrases))
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = {L.PHRASES[m] for m in pattern.findall(re.sub(r"\s+", " ", d["text"].lower()))}
        tags = {L.LICENSES[m][0] for m in re.findall(r"spdx-license-identifier: *([a-z0-9.+-]*[a-z0-9+])", d["text"].lower())}
        if ids or tags:
            want[d["doc_id"]] = tags | {i + "-only" if i.startswith("GPL") else i for i in ids}
    assert got == want


def test_odd_rows(odd, empty):
    rows = L.scan_licenses(odd).collect()
    assert [(r["doc_id"], r["class"]) for r in rows] == [(2, "proprietary")]
    long = odd.selectExpr("doc_id", "concat(text, ' MIT License') as text").where("doc_id = 5")
    assert L.scan_licenses(long).first()["expression"] == "MIT"
    assert L.scan_licenses(empty).count() == 0
    nulls = odd.sparkSession.createDataFrame([(None, "MIT License"), (None, "MIT License")], "doc_id long, text string")
    assert L.scan_licenses(nulls).count() == 2
