"""License scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates.

A tag is "SPDX-License-Identifier:" with the longest valid expression that follows on its line: what comes after it, comment
ends, prose, a full stop, isn't read. A phrase is a notice in words, matched in lower case with white space collapsed, at
word boundaries, the longest where phrases overlap. Phrases that only "or" or "and/or" separates are joined by OR; every
tag and every such group is a finding. The expression of ids, AND, OR, WITH and parentheses is read into postfix order
(WITH binds closest, then AND, then OR) and evaluated: OR may take the freer side, AND must obey the stricter one, WITH
a listed exception (EXCEPTIONS) loosens a copyleft licence by one step; one that isn't listed changes nothing. Findings
are evaluated one by one, and the document has the strictest of their classes: its expression joins them by AND.

Classes, from free to strict: permissive, weak copyleft, copyleft, noncommercial, proprietary, unknown (an id that isn't
listed). A tag without a valid expression is no licence; a document with nothing else has the class invalid, the expression
NOASSERTION and no ids.

Defined results: only documents with a finding are returned. A null or empty text has none. Rows that repeat are returned
each. A null doc_id stays null. An empty table gives no rows. Extra columns are ignored. Texts are read whole, in one pass of
the automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

CLASSES = ("permissive", "weak copyleft", "copyleft", "noncommercial", "proprietary", "unknown")

_PERMISSIVE = "MIT MIT-0 Apache-2.0 Apache-1.1 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD ISC Zlib Unlicense CC0-1.0 CC-BY-3.0 CC-BY-4.0 BSL-1.0 PostgreSQL Python-2.0 PSF-2.0 X11 NCSA WTFPL OFL-1.1 LicenseRef-Public-Domain"
_WEAK = "LGPL-2.0 LGPL-2.1 LGPL-3.0 MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CC-BY-SA-3.0 CC-BY-SA-4.0"
_COPYLEFT = "GPL-1.0 GPL-2.0 GPL-3.0 AGPL-3.0 EUPL-1.2 OSL-3.0 LicenseRef-GPL"
_NONCOMMERCIAL = "CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0"
_PROPRIETARY = "LicenseRef-All-Rights-Reserved LicenseRef-Proprietary NONE"

#: Class number by lower-case id; ids of the GNU family also with -only, -or-later and +.
LICENSES: dict[str, tuple[str, int]] = {}
for _rank, _ids in enumerate((_PERMISSIVE, _WEAK, _COPYLEFT, _NONCOMMERCIAL, _PROPRIETARY)):
    for _id in _ids.split():
        _forms = (_id, _id + "-only", _id + "-or-later", _id + "+") if "GPL-" in _id and not _id.startswith("LicenseRef") else (_id, _id + "+")
        LICENSES |= {x.lower(): (x, _rank) for x in _forms}

#: Notice phrases in lower case; ids of the GNU family get their suffix from what follows.
PHRASES = {
    "mit license": "MIT", "the mit licence": "MIT", "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "apache license, version 2.0": "Apache-2.0", "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache 2.0 license": "Apache-2.0",
    "bsd 2-clause license": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause", "bsd 3-clause license": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "redistribution and use in source and binary forms, with or without modification": "BSD-3-Clause",
    "isc license": "ISC", "mozilla public license, version 2.0": "MPL-2.0", "mozilla public license 2.0": "MPL-2.0", "mozilla public license version 2.0": "MPL-2.0", "eclipse public license 2.0": "EPL-2.0", "eclipse public license - v 2.0": "EPL-2.0",
    "gnu general public license": "LicenseRef-GPL", "gnu gpl": "LicenseRef-GPL",
    **{f"gnu {long}general public license{sep}version {v}": f"{short}-{v if '.' in v else v + '.0'}" for long, short, versions in (("", "GPL", ("1", "2", "3", "2.0", "3.0")), ("lesser ", "LGPL", ("2.1", "3", "3.0")), ("library ", "LGPL", ("2", "2.0")), ("affero ", "AGPL", ("3", "3.0"))) for v in versions for sep in (", ", " ")},
    **{f"gnu {short}{sep}{v}": f"{short.upper()}-{v}.0" for short in ("gpl", "lgpl", "agpl") for v in ("2", "3") for sep in ("v", " v", " version ") if (short, v) not in (("lgpl", "2"), ("agpl", "2"))},
    **{f"{name} {kind} {v}": f"CC-{kind.upper()}-{v}" for name in ("cc", "creative commons") for kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd") for v in ("3.0", "4.0")},
    **{f"creative commons {long} {v}": f"CC-{kind}-{v}" for long, kind in (("attribution", "BY"), ("attribution-sharealike", "BY-SA"), ("attribution-noncommercial", "BY-NC"), ("attribution-noncommercial-sharealike", "BY-NC-SA")) for v in ("3.0", "4.0", "3.0 international license", "4.0 international license", "4.0 international")},
    "cc0": "CC0-1.0", "cc0 1.0 universal": "CC0-1.0", "released into the public domain": "LicenseRef-Public-Domain", "dedicated to the public domain": "LicenseRef-Public-Domain", "the unlicense": "Unlicense",
    "all rights reserved": "LicenseRef-All-Rights-Reserved", "proprietary and confidential": "LicenseRef-Proprietary",
}
PHRASES = {p: re.sub(r"-(\d\.\d) international.*", r"-\1", i) for p, i in PHRASES.items()}

TAG = "spdx-license-identifier:"

#: Exceptions that loosen, in lower case as they follow WITH, by their names.
EXCEPTIONS = {
    x.lower(): x
    for x in (
        "389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 cryptsetup-OpenSSL-exception eCos-exception-2.0 Font-exception-2.0 "
        "freertos-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 GPL-3.0-linking-exception GPL-3.0-linking-source-exception GPL-CC-1.0 LGPL-3.0-linking-exception Libtool-exception "
        "Linux-syscall-note LLVM-exception mif-exception OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Swift-exception "
        "u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1"
    ).split()
}

#: Exceptions as notices say them, after the licence.
_SAID = {"classpath": "Classpath-exception-2.0", "gcc runtime library": "GCC-exception-3.1", "linux syscall": "Linux-syscall-note", "autoconf": "Autoconf-exception-3.0", "bison": "Bison-exception-2.2", "font": "Font-exception-2.0", "libtool": "Libtool-exception"}

#: Words between two phrases that make the first an alternative to the second.
_OR = re.compile(r"[\s,]*(?:and/or|or)(?: under)?(?: the)?(?: terms of)?(?: the)?\s*")
_LATER = re.compile(r"[\s,;(]{0,3}(?:or \(at your option\) any later version|or any later version|or later|and later)")
_WITH = re.compile(rf"[\s,;(]{{0,3}}with (?:the )?({'|'.join(_SAID)})(?: linking)? exception")
_END = re.compile(r"\*/|-->|\*\)|#\}|\n")
_NAME = re.compile(r"[a-z0-9][a-z0-9.+:-]*")
_TOKEN = re.compile(r"[()]|[^\s()]+")
_PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard. ValueError if the expression isn't well formed."""
    out, operators = [], []
    operand = True  # whether an operand is due
    for t in _TOKEN.findall(expression):
        if (op := t.upper()) in _PRECEDENCE:
            if operand:
                raise ValueError(f"operand expected at {t}")
            while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= _PRECEDENCE[op]:
                out.append(operators.pop())
            operators.append(op)
            operand = True
        elif t == "(":
            if not operand:
                raise ValueError("operator expected at (")
            operators.append(t)
        elif t == ")":
            if operand:
                raise ValueError("operand expected at )")
            while operators and operators[-1] != "(":
                out.append(operators.pop())
            if not operators:
                raise ValueError(") without (")
            operators.pop()
        else:
            if not operand:
                raise ValueError(f"operator expected at {t}")
            out.append(t)
            operand = False
    if operand:
        raise ValueError("operand expected at the end")
    while operators:
        if operators[-1] == "(":
            raise ValueError("( without )")
        out.append(operators.pop())
    return out


def evaluate(expression: str) -> tuple[str, list[str]]:
    """The class of an expression and its licence ids, sorted. Exceptions after WITH aren't licences."""
    try:
        postfix = to_postfix(expression)
    except ValueError:
        return "invalid", []
    stack: list[tuple[int, list[str]]] = []
    for t in postfix:
        if t not in _PRECEDENCE:
            name, rank = LICENSES.get(t.lower(), (t, len(CLASSES) - 1))
            stack.append((rank, [name]))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if t == "WITH":
            if len(left) != 1 or len(right) != 1:
                return "invalid", []
            loosens = right[0].lower() in EXCEPTIONS and CLASSES[a] in ("copyleft", "weak copyleft")
            stack.append((a - loosens, left))
        else:
            stack.append((min(a, b) if t == "OR" else max(a, b), left + right))
    return CLASSES[stack[0][0]], sorted(set(stack[0][1]))


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, i in PHRASES.items():
        a.add_word(p, (len(p), i))
    a.add_word(TAG, (len(TAG), TAG))
    a.make_automaton()
    return a


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _phrases(a, s: str) -> list[tuple[int, int, str]]:
    """Start, end and id of the tags and phrases that lie in no longer one, at word boundaries."""
    found = []
    for last, (n, i) in a.iter(s):
        start, end = last - n + 1, last + 1
        if (start == 0 or not _word(s[start - 1])) and (i == TAG or end == len(s) or not _word(s[end])):
            found.append((start, end, i))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[1] > out[-1][1]:
            out.append(f)
    return out


def longest_expression(line: str) -> str | None:
    """The longest valid expression with which a line (in lower case) begins; None if there is none.

    An id is listed, or looks like one: it has a hyphen, a digit, a colon or a plus sign. So prose ends the expression.
    """
    tokens: list[str] = []
    valid, depth, operand = 0, 0, True
    for t in _TOKEN.findall(line):
        op = t.upper() if t.upper() in _PRECEDENCE else None
        if t == "(" and operand:
            depth += 1
        elif t == ")" and not operand and depth:
            depth -= 1
        elif op and not operand and not (op == "WITH" and (tokens[-1] == ")" or tokens[-2:-1] == ["WITH"])):
            t, operand = op, True
        elif t not in "()" and operand and not op:
            bare = t if t in LICENSES else t.rstrip(".,;:!?\"'")
            if not _NAME.fullmatch(bare):
                break
            if tokens and tokens[-1] == "WITH":
                if bare not in EXCEPTIONS and not bare.endswith("exception") and "exception-" not in bare:
                    break
                name = EXCEPTIONS.get(bare, bare)
            elif bare in LICENSES:
                name = LICENSES[bare][0]
            elif any(c in "-:+" or c.isdigit() for c in bare):
                name = bare
            else:
                break
            tokens.append(name)
            operand = False
            if depth == 0:
                valid = len(tokens)
            if bare != t:  # what followed the id ends the expression
                break
            continue
        else:
            break
        tokens.append(t)
        if t == ")" and depth == 0:
            valid = len(tokens)
    return " ".join(tokens[:valid]) or None


def scan(a, text: str) -> tuple[str, list[str], str] | None:
    """The licence expression of a text, its ids and its class; None if nothing is found."""
    # Lines stay told apart by their breaks, and in s each break is a blank, so that phrases may go over lines.
    lines = text.lower().replace("\t", " ").replace("\r", " ")
    if "  " in lines:
        lines = re.sub(r" {2,}", " ", lines)
    if "\n\n" in lines or " \n" in lines or "\n " in lines:
        lines = re.sub(r" ?\n[ \n]*", "\n", lines)
    s = lines.replace("\n", " ")
    groups: list[list[str]] = []
    previous, over, invalid = None, 0, False
    for start, end, i in _phrases(a, s):
        if start < over:  # within the expression of a tag
            continue
        if i == TAG:
            stop = _END.search(lines, end)
            over = stop.start() if stop else len(lines)
            if expression := longest_expression(lines[end:over]):
                groups.append([expression])
            else:
                invalid, over = True, end
            previous = None
            continue
        if i.startswith(("GPL", "LGPL", "AGPL")):
            later = _LATER.match(s, end)
            i, end = (i + "-or-later", later.end()) if later else (i + "-only", end)
        if "GPL" in i and (said := _WITH.match(s, end)):
            i, end = f"{i} WITH {_SAID[said[1]]}", said.end()
        if previous is not None and start > previous and _OR.fullmatch(s, previous, start):
            groups[-1].append(i)
        else:
            groups.append([i])
        previous = end
    findings = list(dict.fromkeys(" OR ".join(dict.fromkeys(g)) for g in groups))
    if not findings:
        return ("NOASSERTION", [], "invalid") if invalid else None
    judged = [evaluate(f) for f in findings]
    strictest = max(CLASSES.index(kind) for kind, _ in judged)
    whole = findings[0] if len(findings) == 1 else " AND ".join(f"({f})" if " OR " in f else f for f in findings)
    return whole, sorted({x for _, ids in judged for x in ids}), CLASSES[strictest]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = automaton()
    for b in batches:
        rows = []
        for doc, t in zip(b.column("doc_id"), b.column("text"), strict=True):
            if (t := t.as_py()) and (found := scan(a, t)):
                rows.append((doc.as_py(), *found))
        if rows:
            doc, expression, ids, kind = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(expression, pa.string()), pa.array(ids, pa.list_(pa.string())), pa.array(kind, pa.string())], names=["doc_id", "expression", "licenses", "class"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, expression, licenses and class of every document with a finding. Nothing shuffles."""
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(_run, "doc_id bigint, expression string, licenses array<string>, class string")
