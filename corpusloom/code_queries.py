"""Registered queries over source code: a few templates with strings, comments, nesting and errors, told apart by the document's number.

What is to be found in each is written beside it; ``NNN`` stands for the number.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import parsers
from corpusloom.operators import structural
from corpusloom.registry import docs, query_of


class Sample(NamedTuple):
    """A text of a language; its header after the path, its signatures, its blocks by name, and what a later text differs in."""

    lang: str
    text: str
    header: str
    signatures: str
    blocks: tuple[tuple[str, str, str], ...]
    later: str
    changes: str


SAMPLES = (
    Sample(
        lang='python',
        text="from os import path\nimport sys, m_NNN\n\n@deco(NNN)\ndef f_NNN(x: int) -> str:\n    '''def not_here(): {'''\n    def inner():\n        return 1\n    return str(x)\n\nclass K(Base):\n    a = NNN\n\n    def g(self):\n        pass\n",
        header='deps: m_NNN, os, sys\nexports: K, f_NNN\n',
        signatures='from os import path\nimport sys, m_NNN\n\n@deco(NNN)\ndef f_NNN(x: int) -> str:\n    ...\n    return str(x)\n\nclass K(Base):\n    ...',
        blocks=(
            ('K', 'class K(Base):', '    a = NNN\n\n    def g(self):\n        pass'),
            ('f_NNN', '@deco(NNN)\ndef f_NNN(x: int) -> str:', "    '''def not_here(): {'''\n    def inner():\n        return 1\n    return str(x)"),
        ),
        later='from os import path\n\n@deco(NNN)\ndef f_NNN(x: int, y=1) -> str:\n    return str(x)\n\nclass K(Base):\n    a = NNN\n\n    def g(self):\n        pass\n',
        changes="MODIFIED: f_NNN\n  Signature changed:\n    - @deco(NNN)\ndef f_NNN(x: int) -> str:\n    + @deco(NNN)\ndef f_NNN(x: int, y=1) -> str:\n  Body:\n    ### \n    REMOVED lines 1-3:\n            '''def not_here(): {'''\n            def inner():\n                return 1\n\n",
    ),
    Sample(
        lang='python',
        text='import (a_NNN, b)\nfrom pkg.sub import thing\nimport json, re\ndef broken(:\n    pass\n',
        header='deps: (a_NNN, a_NNN, b, b), json, pkg.sub, re\n',
        signatures='import (a_NNN, b)\nfrom pkg.sub import thing\nimport json, re\ndef broken(:\n    pass\n',
        blocks=(
        ),
        later='import json\ndef broken(:\n    return NNN\n',
        changes='\nREMOVED lines 1-3:\n    import (a_NNN, b)\n    from pkg.sub import thing\n    import json, re\n\nREMOVED lines 5:\n        pass\n\nADDED lines 1:\n    import json\n\nADDED lines 3:\n        return NNN\n',
    ),
    Sample(
        lang='javascript',
        text='import type { T } from \'./types_NNN\'\nimport def from "lib"\nimport \'side\'\nconst { a, b } = require(\'pair\')\nexport async function run_NNN(a) {\n  if (a) { return b }\n  // done\n}\nexport class C {\n  go() { return \'x\' }\n}\n',
        header='deps:  T ,  a, b , ./types_NNN, lib, pair, side\nexports: C, run_NNN\n',
        signatures='export async function run_NNN(a)\nexport class C',
        blocks=(
            ('C', 'export class C', "{\n  go() { return 'x' }\n}"),
            ('run_NNN', 'export async function run_NNN(a)', '{\n  if (a) { return b }\n  // done\n}'),
        ),
        later='export async function run_NNN(a, c) {\n  if (a) { return b }\n  // done\n}\nfunction more() {\n  return NNN\n}\n',
        changes='DELETED: C\n\nADDED: function more\nfunction more()\n{\n  return NNN\n}\n\nMODIFIED: run_NNN\n  Signature changed:\n    - export async function run_NNN(a)\n    + export async function run_NNN(a, c)\n\n',
    ),
    Sample(
        lang='cpp',
        text='#include <vector>\n#include "own_NNN.h"\nusing std_NNN.io;\nstruct S_NNN {\n  int x; /* { */\n};\nenum E { A, B };\n',
        header='deps: own_NNN.h, std_NNN.io, vector\nexports: E, S_NNN\n',
        signatures='struct S_NNN\nenum E',
        blocks=(
            ('E', 'enum E', '{ A, B }'),
            ('S_NNN', 'struct S_NNN', '{\n  int x; /* { */\n};\nenum E { A, B };\n'),
        ),
        later='struct S_NNN {\n  int x; /* { */\n  int y;\n};\nenum E { A, B };\n',
        changes='MODIFIED: S_NNN\n  Body:\n    ### \n    ADDED lines 3:\n          int y;\n\n',
    ),
    Sample(
        lang='go',
        text='func main_NNN(a int) int {\n\tif a > 0 {\n\t\treturn "{"\n\t}\n\treturn NNN\n}\ntype T_NNN struct {\n\tx int\n}\n',
        header='exports: main_NNN\n',
        signatures='func main_NNN(a int) int\ntype T_NNN struct',
        blocks=(
            ('T_NNN', 'type T_NNN struct', '{\n\tx int\n}'),
            ('main_NNN', 'func main_NNN(a int) int', '{\n\tif a > 0 {\n\t\treturn "{"\n\t}\n\treturn NNN\n}\ntype T_NNN struct {\n\tx int\n}\n'),
        ),
        later='func main_NNN(a int) int {\n\treturn 0\n}\n',
        changes='DELETED: T_NNN\n\nMODIFIED: function main_NNN\n  Body:\n    ### \n    REMOVED lines 2-9:\n        \tif a > 0 {\n        \t\treturn "{"\n        \t}\n        \treturn NNN\n        }\n        type T_NNN struct {\n        \tx int\n        }\n    ADDED lines 2-3:\n        \treturn 0\n        }\n\n',
    ),
    Sample(
        lang='ruby',
        text='require \'json_NNN\'\nrequire "set"\nclass A\n  def self.go?(x)\n    x\n  end\nend\ndef plain!\n  NNN\nend\n',
        header='deps: json_NNN, set\nexports: go?, plain!\n',
        signatures='def self.go?(x)\ndef plain!',
        blocks=(
            ('go?', 'def self.go?(x)', 'x\n  end\nend\ndef plain!\n  NNN\nend'),
            ('plain!', 'def plain!', 'NNN\nend'),
        ),
        later='def self.go?(x, y)\n  x\nend\n',
        changes='MODIFIED: function go?\n  Signature changed:\n    - def self.go?(x)\n    + def self.go?(x, y)\n  Body:\n    ### \n    REMOVED lines 2-5:\n          end\n        end\n        def plain!\n          NNN\n\nDELETED: function plain!\n\n',
    ),
    Sample(
        lang='elixir',
        text='import "Mod"\nuse Other.Mod_NNN\ndefmodule App.M_NNN do\n  def run(x) do\n    x\n  end\n  defp hidden(y), do: y\nend\n',
        header='deps: Mod, Other.Mod_NNN\nexports: App.M_NNN, hidden, run\n',
        signatures='def run(x) do\ndefmodule App.M_NNN do\ndefp hidden(y), do: y',
        blocks=(
            ('App.M_NNN', 'defmodule App.M_NNN do', 'def run(x) do\n    x\n  end\n  defp hidden(y), do: y\nend'),
            ('hidden', 'defp hidden(y), do: y', 'end'),
            ('run', 'def run(x) do', 'x\n  end\n  defp hidden(y), do: y\nend'),
        ),
        later='defmodule App.M_NNN do\n  def run(x, z) do\n    x\n  end\nend\n',
        changes='MODIFIED: App.M_NNN\n  Body:\n    ### \n    REMOVED lines 1:\n        def run(x) do\n    REMOVED lines 4:\n          defp hidden(y), do: y\n    ADDED lines 1:\n        def run(x, z) do\n\nDELETED: hidden\n\nMODIFIED: function run\n  Signature changed:\n    - def run(x) do\n    + def run(x, z) do\n  Body:\n    ### \n    REMOVED lines 3:\n          defp hidden(y), do: y\n\n',
    ),
    Sample(
        lang='text',
        text='nothing to read in NNN\n',
        header='',
        signatures='nothing to read in NNN\n',
        blocks=(
        ),
        later='nothing to see in NNN\n',
        changes='\nREMOVED lines 1:\n    nothing to read in NNN\n\nADDED lines 1:\n    nothing to see in NNN\n',
    ),
)


def _of_sample(values: list[str]) -> Column:
    """The value of a document's sample, with its number."""
    chosen = F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(SAMPLES) + 1).cast("int"))
    return F.replace(chosen, F.lit("NNN"), F.col("doc_id").cast("string"))


def _quoted(text: str) -> str:
    return "replace('" + text.replace("'", "''") + "', 'NNN', CAST(doc_id AS VARCHAR))"


def _sql(values: list[str]) -> str:
    """The same in DuckDB's SQL."""
    return f"CASE doc_id % {len(SAMPLES)} " + " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values)) + " END"


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"lang": [x.lang for x in SAMPLES], "text": [x.text for x in SAMPLES], "later": [x.later for x in SAMPLES]}
    return docs(spark, sf_dir).select("doc_id", *[_of_sample(v).alias(k) for k, v in columns.items()])


query_of("code_headers", f"SELECT doc_id, CASE WHEN h = '' THEN '' ELSE concat('### ', doc_id, chr(10), h) END AS header FROM (SELECT doc_id, {_sql([x.header for x in SAMPLES])} AS h FROM documents)")(
    lambda s, d: _code(s, d).select("doc_id", parsers.header(F.col("doc_id").cast("string"), *parsers.header_parts(F.col("text"), F.col("lang"))).alias("header"))
)
query_of("code_signatures", f"SELECT doc_id, {_sql([x.signatures for x in SAMPLES])} AS signatures FROM documents")(lambda s, d: _code(s, d).select("doc_id", parsers.signatures(F.col("text"), F.col("lang")).alias("signatures")))
query_of(
    "code_blocks",
    " UNION ALL ".join(f"SELECT doc_id, {', '.join(f'{_quoted(v)} AS {k}' for k, v in zip(('name', 'signature', 'body'), b, strict=True))} FROM documents WHERE doc_id % {len(SAMPLES)} = {i}" for i, x in enumerate(SAMPLES) for b in x.blocks),
)(lambda s, d: _code(s, d).select("doc_id", F.explode(parsers.blocks(F.col("text"), F.col("lang"))).alias("b")).select("doc_id", "b.*"))
query_of("structural_diff", f"SELECT doc_id, concat('### ', doc_id, chr(10), {_sql([x.changes for x in SAMPLES])}) AS content FROM documents")(
    lambda s, d: _code(s, d).select("doc_id", structural.structural_diffs()(F.col("text"), F.col("later"), F.col("doc_id").cast("string"), F.col("lang")).alias("content"))
)


class Scoped(NamedTuple):
    """A text of a language that is read by its scopes, and its blocks by name: head, body."""

    lang: str
    text: str
    blocks: tuple[tuple[str, str, str], ...]


SCOPES = (
    Scoped(
        "javascript",
        "import x from 'y';\n// don't { count\nexport async function run_NNN(a, {b} = {}) {\n  function inner() { return '}' }\n  return /[{}/]\\/\"/.test(a) ? `t ${ {z: 1}.z } }` : a / b / NNN\n}\nclass C extends B {\n  static go(x = {}) { for (const y of x) { w(y) } }\n  on = (e) => { this.go(e) }\n}\nconst arrow = async (a) => {\n  return a\n};\n",
        (
            ("run_NNN", "export async function run_NNN(a, {b} = {})", "{\n  function inner() { return '}' }\n  return /[{}/]\\/\"/.test(a) ? `t ${ {z: 1}.z } }` : a / b / NNN\n}"),
            ("run_NNN.inner", "function inner()", "{ return '}' }"),
            ("C", "class C extends B", "{\n  static go(x = {}) { for (const y of x) { w(y) } }\n  on = (e) => { this.go(e) }\n}"),
            ("C.go", "static go(x = {})", "{ for (const y of x) { w(y) } }"),
            ("C.on", "on = (e) =>", "{ this.go(e) }"),
            ("arrow", "const arrow = async (a) =>", "{\n  return a\n}"),
        ),
    ),
    Scoped(
        "typescript",
        "interface I_NNN<T> { a: string; b(): void }\ntype A = { x: number }\nnamespace N { export function f<T>(a: T): T { return a /* } */ } }\nabstract class K { private m<U>(a: U): Promise<U> { return x } }\n",
        (
            ("I_NNN", "interface I_NNN<T>", "{ a: string; b(): void }"),
            ("A", "type A =", "{ x: number }"),
            ("N", "namespace N", "{ export function f<T>(a: T): T { return a /* } */ } }"),
            ("N.f", "export function f<T>(a: T): T", "{ return a /* } */ }"),
            ("K", "abstract class K", "{ private m<U>(a: U): Promise<U> { return x } }"),
            ("K.m", "private m<U>(a: U): Promise<U>", "{ return x }"),
        ),
    ),
    Scoped(
        "go",
        "package p\n// }\nfunc main_NNN(a int) (int, error) {\n\tif a > 0 { return \"{\", nil }\n\tf := func() { x := `}` ; _ = x }\n\treturn '}', nil\n}\ntype T struct {\n\tx int\n}\nfunc (t *T) Get() int { return t.x }\nfunc broken() {\n",
        (
            ("main_NNN", "func main_NNN(a int) (int, error)", "{\n\tif a > 0 { return \"{\", nil }\n\tf := func() { x := `}` ; _ = x }\n\treturn '}', nil\n}"),
            ("T", "type T struct", "{\n\tx int\n}"),
            ("T.Get", "func (t *T) Get() int", "{ return t.x }"),
            ("broken", "func broken()", "{\n"),
        ),
    ),
)


@query_of("code_scopes", " UNION ALL ".join(f"SELECT doc_id, {', '.join(f'{_quoted(v)} AS {k}' for k, v in zip(('name', 'signature', 'body'), b, strict=True))} FROM documents WHERE doc_id % {len(SCOPES)} = {i}" for i, x in enumerate(SCOPES) for b in x.blocks))
def _by_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods, arrow functions, nested functions and types with their exact ends."""
    chosen = lambda values: F.replace(F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(SCOPES) + 1).cast("int")), F.lit("NNN"), F.col("doc_id").cast("string"))
    rows = docs(spark, sf_dir).select("doc_id", chosen([x.lang for x in SCOPES]).alias("lang"), chosen([x.text for x in SCOPES]).alias("text"))
    return rows.select("doc_id", F.explode(parsers.blocks(F.col("text"), F.col("lang"), scoped=True)).alias("b")).select("doc_id", "b.*")
