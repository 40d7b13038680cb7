"""Derived probe text for detectors the driver data never triggers.

The driver tables hold no IBAN, SSN, German or international phone number,
passport, address, keyword phrase ... (see FIXTURES). Probe queries therefore
append a short phrase computed from the row id to *every* row -- all rows are
still read and matched in full; the phrase only guarantees coverage. The
expression is plain SQL that Spark (``F.expr``) and DuckDB both evaluate
identically, so the oracle uses the same text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


def planted_sql(id_col: str) -> str:
    i = id_col
    variants = [
        f"concat('my SSN is ', {_d(f'({i} * 37) % 1000', 3)}, '-', {_d(f'{i} % 100', 2)}, '-', {_d(f'({i} * 91) % 10000', 4)})",
        f"concat('tax id ', {_d(f'({i} * 7919) % 1000000000', 9)})",
        f"concat('IBAN DE', {_d(f'{i} % 100', 2)}, ' 3704 0044 ', {_d(f'{i} % 10000', 4)}, ' 1320 13')",
        f"concat('iban GB', {_d(f'{i} % 100', 2)}, 'NWBK', {_d(f'({i} * 13) % 10000000', 7)}, 'X1')",
        f"concat('ruf an 0', CAST(170 + {i} % 9 AS STRING), ' ', {_d(f'({i} * 7) % 100000000', 8)}, ' oder an u', CAST({i} AS STRING), '@post.org')",
        f"concat('call +', CAST(1 + {i} % 98 AS STRING), ' ', CAST(100 + {i} % 900 AS STRING), ' ', {_d(f'{i} % 10000000', 7)})",
        f"concat('passport ', CASE WHEN {i} % 40 < 20 THEN 'X' ELSE 'ab' END, {_d(f'({i} * 3) % 10000000', 7)})",
        f"concat('I live at ', CAST(1 + {i} % 9999 AS STRING), ' Maple Grove ', CASE WHEN {i} % 40 < 20 THEN 'Street' ELSE 'Terrace' END)",
        f"concat('born ', {_d(f'1 + {i} % 12', 2)}, '/', {_d(f'{i} % 31', 2)}, '/19', {_d(f'{i} % 100', 2)})",
        f"concat('DL-AB', CAST(10 + {i} % 90 AS STRING), '-', {_d(f'{i} % 100000', 5)}, '-', {_d(f'{i} % 100', 2)})",
        f"concat('routing number ', {_d(f'({i} * 101) % 1000000000', 9)}, ' and account no. ', {_d(f'{i} % 100000000', 8)})",
        f"concat('my salary is $', CAST(40000 + {i} % 90000 AS STRING), ' per year')",
        "'I am worried because my doctor changed my medication'",
        f"concat('my wife Anna owes $', CAST({i} % 5000 AS STRING))",
        "'I was arrested and my lawyer said the court date moved'",
        "'Can you explain the difference between a list and a tuple?'",
        "'Mein Arzt sagt, ich wurde krank geschrieben'",
        "'I have a question: what is a monad?'",
        "'def test fixture: import faker'",
        "'nothing to see here'",
    ]
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(variants[:-1]))
    return f"CASE {i} % {len(variants)} {whens} ELSE {variants[-1]} END"


def probe_text_sql(text_col: str, id_col: str) -> str:
    return f"concat(coalesce({text_col}, ''), ' ', {planted_sql(id_col)})"


def probe_text(text_col: str, id_col: str) -> Column:
    return F.expr(probe_text_sql(text_col, id_col))
