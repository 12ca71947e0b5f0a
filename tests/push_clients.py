"""Clients for the push source's tests; what they are told lies in files, since tasks run in other processes."""

from __future__ import annotations

import json
import uuid
from pathlib import Path


def working(options):
    def push(rows):
        Path(options["folder"], uuid.uuid4().hex).write_text(json.dumps(rows))

    return push


def forbidding(options):
    def push(rows):
        raise RuntimeError("403 Forbidden")

    return push


def choosy(options):
    def push(rows):
        if any(r["n"] % 10 == 0 for r in rows):
            raise RuntimeError("bad row")
        Path(options["folder"], uuid.uuid4().hex).write_text(json.dumps(rows))

    return push


def told(options, how, total):
    Path(options["folder"], f"_{how}").write_text(json.dumps([total.pushed, total.failed, total.tries]))
