"""python -m docquarry.cli PATH: the text of a file, or its JSON."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from .formats.dispatch import read_file
from .serialization import to_json

FORMS = ("text", "json", "units")


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("docquarry", description="Print the text of a file.", exit_on_error=False)
    parser.add_argument("path")
    shapes = parser.add_mutually_exclusive_group()
    for flag, form, said in (("--json", "json", "all that was found, as JSON"), ("--json-unit", "units", "the units as JSON")):
        shapes.add_argument(flag, dest="form", action="store_const", const=form, default="text", help=said)
    parser.add_argument("--binary", help="with JSON, images and attachments too", action="store_true")
    known, rest = parser.parse_known_args(argv)
    if rest:
        raise ValueError(f"unknown arguments: {' '.join(rest)}")
    if known.binary and known.form == "text":
        raise ValueError("--binary is for JSON only")
    return known


def rendered(path: str, form: str = "text", binary: bool = False) -> str:
    """What is printed for a file, in one of FORMS."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no such file: {path}")
    docs = list(read_file(path))
    if not docs:
        raise ValueError(f"nothing was found in {path}")
    if form == "text":
        return "\n\n".join(d.full_text.rstrip() for d in docs).rstrip()
    found = [to_json(d.units if form == "units" else d, binary) for d in docs]
    return json.dumps(found if len(found) > 1 else found[0])


def main(argv: Sequence[str] | None = None) -> int:
    """0, or 1 with the reason on the error stream."""
    try:
        asked = _arguments(argv)
        print(rendered(asked.path, asked.form, asked.binary))
    except SystemExit as stop:
        return stop.code if isinstance(stop.code, int) else 1
    except Exception as error:  # noqa: BLE001
        sys.stderr.write(f"docquarry: {error}\n")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
