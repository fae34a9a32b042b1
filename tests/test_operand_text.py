"""Operands of operations as JSON text in table functions."""

import json

from pagequarry.functions import table_functions
from pagequarry.kernels import content


def test_operands_are_said_as_json_and_one_string_without_an_encoder(monkeypatch):
    data = b"BT (a\"b\\\\) Tj <00ff> Tj () Tj /F1 9 Tf [(a) -3 /N] TJ 1.5 0 Td T* (x"
    expected = [(k, op, json.dumps(a), at, None) if op != "error" else (k, None, None, at, a[0]) for k, (op, a, at) in enumerate(content.operations(data))]
    assert list(table_functions.PdfOperations().eval(data)) == expected
    monkeypatch.setattr(table_functions.json, "dumps", None)
    assert [r[2] for r in table_functions.PdfOperations().eval(data, "Tj")][:3] == ['["s:6122625c"]', '["s:00ff"]', '["s:"]']
