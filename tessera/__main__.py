"""python -m tessera encode|decode|inspect: single files, without Spark."""

from __future__ import annotations

import sys

from .sources import container


def main(args: list[str]) -> int:
    if len(args) == 3 and args[0] == "encode":
        raw = open(args[1], "rb").read()
        made = container.encode(raw)
        open(args[2], "wb").write(made)
        print(f"{len(raw)} -> {len(made)} bytes ({len(made) / max(1, len(raw)):.3f})")
    elif len(args) == 3 and args[0] == "decode":
        open(args[2], "wb").write(container.decode(open(args[1], "rb").read()))
    elif len(args) == 2 and args[0] == "inspect":
        blob = open(args[1], "rb").read()
        pipeline, size, sections = container.inspect(blob)
        print(f"pipeline {pipeline}, original size {size}, {len(sections)} sections")
        for i, s in enumerate(sections):
            body = blob[s.offset : s.offset + s.length]
            state = "out of bounds" if len(body) < s.length else "ok" if container.fnv1a(body) == s.checksum else "bad"
            print(i, container.NAMES.get(s.kind, s.kind), s.codec, s.offset, s.length, f"{s.checksum:08x}", state)
    else:
        print("usage: python -m tessera encode IN OUT | decode IN OUT | inspect FILE")
        return 2
    return 0


if __name__ == "__main__":
    try:
        sys.exit(main(sys.argv[1:]))
    except (container.ContainerError, OSError) as e:
        sys.exit(f"error: {e}")
