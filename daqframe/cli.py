"""python -m daqframe.cli [decode] FILE [-f|--format csv|json|cbor] [-o|--output PATH|-]. Exit code 0; 1 for bad data; 2 for bad usage."""

from __future__ import annotations

import sys
from pathlib import Path

from daqframe.wire import FormatError

USAGE = "usage: [decode] FILE [-f|--format json|cbor|csv] [-o|--output PATH|-]"
OPTIONS = {"-f": "format", "--format": "format", "-o": "output", "--output": "output"}


def number(x: float | None) -> str:
    if x is None:
        return ""
    return str(int(x)) if x == x // 1 and abs(x) < 1e15 else repr(x)


def csv_text(data: bytes) -> str:
    from daqframe.codec import FIXED
    from daqframe.sources.export import CSV_HEADER, sample_value
    from daqframe.tables import decode_bytes

    def cell(x: str) -> str:
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\r\n') else x

    lines = [CSV_HEADER]
    for r in decode_bytes(data).to_pylist():
        raw = sample_value(r)
        raw = raw.hex() if isinstance(raw, bytes) else number(raw) if isinstance(raw, float) else str(raw)
        ticks = "" if r["time_ticks"] is None else str(r["time_ticks"])
        physical = "" if r["logical_type"] == FIXED else number(r["physical"])
        lines.append(",".join([str(r["sequence"]), str(r["stream_id"]), str(r["sample_index"]), ticks, str(r["channel_id"]), cell(r["channel_name"]), str(r["element"]), raw, physical, cell(r["unit"] or "")]))
    return "\n".join(lines) + "\n"


def main(args: list[str]) -> int:
    from daqframe.sources.export import cbor, document, to_json

    if not args or "--help" in args or "-h" in args:
        print(USAGE, file=sys.stderr)
        return 0 if args else 2
    options, rest = {"format": "json", "output": "-"}, list(args)
    try:
        if rest[0] == "decode":
            rest.pop(0)
        path = rest.pop(0)
        if path.startswith("-"):
            raise ValueError("a path must come first")
        while rest:
            key = rest.pop(0)
            options[OPTIONS[key]] = rest.pop(0)
        kind = options["format"].lower()
        if kind not in ("csv", "json", "cbor"):
            raise ValueError(f"format {kind}")
    except (IndexError, KeyError, ValueError):
        print(USAGE, file=sys.stderr)
        return 2
    try:
        data = Path(path).read_bytes()
        out = csv_text(data).encode() if kind == "csv" else cbor(document(data)) if kind == "cbor" else (to_json(document(data)) + "\n").encode()
    except (OSError, FormatError) as e:
        print(e, file=sys.stderr)
        return 1
    if options["output"] == "-":
        sys.stdout.buffer.write(out)
    else:
        Path(options["output"]).write_bytes(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
