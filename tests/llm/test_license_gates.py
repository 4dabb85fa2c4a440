"""Every match of a licence rule passes the rule's own gate, and the gates change no result."""

from __future__ import annotations

import random
import re
from re import _constants as C
from re import _parser

import pytest

from corpusloom.llm import license_scan
from corpusloom.llm.license_rules import rules


def sample(rng, parsed):
    out = ""
    for op, arg in parsed:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.ANY:
            out += "x"
        elif op is C.IN:
            out += chr(rng.choice([c for kind, x in arg for c in ([x] if kind is C.LITERAL else range(x[0], x[1] + 1))]))
        elif op is C.BRANCH:
            out += sample(rng, rng.choice(arg[1]))
        elif op is C.SUBPATTERN:
            out += sample(rng, arg[-1])
        else:
            assert op in (C.MAX_REPEAT, C.MIN_REPEAT), op
            out += "".join(sample(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
    return out


def samples(rule, n):
    rng, parsed = random.Random(rule.pattern), _parser.parse(rule.pattern)
    return {" ".join(sample(rng, parsed).split()) for _ in range(n)}


def test_every_match_passes_its_gate():
    lost = {(r.label, r.keyword, s) for r in rules() for s in samples(r, 300) if f" {r.keyword}" not in f" {s}"}
    assert not lost


def ungated(norm, table):
    found = [(m.start(), -m.end(), r.priority, r.label, r.confidence) for r in table for m in re.finditer(f"(?<![^ ])(?:{r.pattern})(?![^ ])", norm)]
    kept = []
    for x in sorted(found):
        if not kept or x[0] >= -kept[-1][1]:
            kept.append(x)
        elif -x[1] > -kept[-1][1] and x[2] < kept[-1][2]:
            kept[-1] = x
    return kept


def test_scan_against_the_ungated_model(spark):
    table = rules()
    made = sorted({f"see {s} here" for r in table for s in samples(r, 2)})
    got = {r.text: [tuple(s) for s in r.spans] for r in spark.createDataFrame([(x,) for x in made], "text string").repartition(8).select("text", license_scan.detections(license_scan.normalized("text")).alias("spans")).collect()}
    assert got == {x: ungated(x, table) for x in made}


@pytest.mark.parametrize("line", [
    "OFL-1.1 ofl-1.1", "BSL-1.0 boost-1", "BUSL-1.1 bsl-1.1", "EPL-1.0 epl-1", "EPL-2.0 epl-2", "MPL-1.1 mpl-1.1", "MPL-2.0 mpl-2", "MS-PL ms-pl", "MS-RL ms-rl", "ODbL-1.0 odbl-1", "AFL-3.0 afl-3",
    "OSL-3.0 osl-3", "ECL-2.0 ecl-2", "LPPL-1.3c lppl-1.3", "SSPL-1.0 sspl-1", "UPL-1.0 upl-1", "CPL-1.0 cpl-1", "IPL-1.0 ibm-pl-1", "PDDL-1.0 pddl-1", "ODC-By-1.0 odc-by-1", "ZPL-2.1 zpl-2", "OLDAP-2.8 openldap",
    "QPL-1.0 qpl-1", "PSF-2.0 python-2", "EUPL-1.2 eupl-1.2", "CC-BY-SA-4.0 cc-by-sa", "GFDL-1.3-only gfdl", "MulanPSL-2.0 mulan-2", "AGPL-3.0-or-later agpl-3", "0BSD bsd-0-clause", "CDDL-1.0 cddl-1",
])
def test_real_identifiers(line):
    identifier, label = line.split()
    norm = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", f"SPDX-License-Identifier: {identifier}".lower()).strip()
    assert any(r.label == label and r.priority == 10 and re.fullmatch(r.pattern, norm) and f" {r.keyword}" in f" {norm}" for r in rules())


def test_texts_that_lost_their_label(spark):
    texts = {"GFDL 1.3": "gfdl", "Expat license": "mit", "GNU Library General Public License version 2": "lgpl-2.1", "SPDX-License-Identifier: OFL-1.1": "ofl-1.1", "http://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa", "https://opensource.org/licenses/MIT": "mit"}
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {list(texts)[r.doc_id]: r.labels for r in got} == texts
