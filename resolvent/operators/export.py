"""A run as a program of its own: the SQL of its queries, as a script and as a notebook."""

from __future__ import annotations

import json

HEAD = '''"""The queries of a run, in order. Needs duckdb and the folder of the tables as its argument."""

import sys

import duckdb

con = duckdb.connect()
for table in {tables!r}:
    con.execute(f"CREATE VIEW {{table}} AS SELECT * FROM read_parquet('{{sys.argv[1]}}/{{table}}.parquet')")
'''
STEP = '''
# {title}
{name} = con.execute({sql}).df()
print("{name}", len({name}))
'''


def _quoted(sql: str) -> str:
    return 'r"""' + sql.replace('"""', '\\"\\"\\"') + '"""' if not sql.endswith(("\\", '"')) else repr(sql)


def steps(queries: dict, oracles: dict[str, str], names: list[str] | None = None) -> list[tuple[str, str, str]]:
    """(title, name, SQL) of the queries asked for, in the order of the registry, that SQL can express."""
    wanted = [n for n in queries if n in oracles and (names is None or n in names)]
    return [((queries[n].__doc__ or n).strip().split("\n")[0], n, oracles[n]) for n in wanted]


def script(found: list[tuple[str, str, str]], tables: list[str]) -> str:
    return HEAD.format(tables=tables) + "".join(STEP.format(title=t, name=n, sql=_quoted(s)) for t, n, s in found)


def notebook(found: list[tuple[str, str, str]], tables: list[str]) -> str:
    """The same as JSON of a notebook: a cell of text and one of code for each query."""
    cell = lambda kind, text: {"cell_type": kind, "metadata": {}, "source": text.splitlines(keepends=True), **({"execution_count": None, "outputs": []} if kind == "code" else {})}
    cells = [cell("code", HEAD.format(tables=tables).replace("sys.argv[1]", '"tables"'))]
    for t, n, s in found:
        cells += [cell("markdown", t), cell("code", STEP.format(title=t, name=n, sql=_quoted(s)).lstrip("\n"))]
    return json.dumps({"cells": cells, "metadata": {"kernelspec": {"name": "python3", "display_name": "Python 3", "language": "python"}}, "nbformat": 4, "nbformat_minor": 5}, indent=1)
