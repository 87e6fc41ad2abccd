"""``python -m emberfold``: register, list, use, gc, query and serve."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from . import __version__, registry
from .errors import ApiError


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="emberfold", description="Folded-stack profiles on Spark")
    parser.add_argument("--max-file-size-mib", type=int, default=512)
    parser.add_argument("--cache-capacity", type=int, default=8)
    parser.add_argument("--version", action="version", version=f"emberfold {__version__}")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("register", help="store a profile and make it active")
    c.add_argument("profile", type=Path)
    c.add_argument("--name")
    commands.add_parser("list", help="the registered profiles")
    c = commands.add_parser("use", help="make an alias active")
    c.add_argument("alias")
    c = commands.add_parser("gc", help="remove stored profiles that no alias names")
    c.add_argument("--dry-run", action="store_true")
    c = commands.add_parser("query", help="one question, its arguments as JSON")
    c.add_argument("tool", choices=["summary", "find_symbols", "top", "tree", "callers", "callees", "paths", "diff"])
    c.add_argument("arguments", nargs="?", default="{}")
    c = commands.add_parser("serve", help="answer questions as tools over standard input and output")
    c.add_argument("--mcp", action="store_true", required=True, help="the protocol to speak")
    a = parser.parse_args(args)
    here, most = Path.cwd(), a.max_file_size_mib * 1024 * 1024
    try:
        if a.command == "register":
            from .sources.folded import Limits, read_profile

            print(json.dumps(registry.register(here, a.profile, a.name, most, lambda p: read_profile(_spark(), str(p), Limits(file_bytes=most)))))
        elif a.command == "list":
            s = registry.status(here)
            print(f"registry={s['registry_root']}\nactive={s['active']}")
            for e in s["profiles"]:
                print(f"{'*' if e['alias'] == s['active'] else ' '} {e['alias']} fingerprint={e['fingerprint']} bytes={e['byte_len']} source={e['source_name']}")
        elif a.command == "use":
            print(f"active alias={registry.set_active(here, a.alias)['active']}")
        elif a.command == "gc":
            done = registry.gc(here, a.dry_run)
            print(f"registry={done['registry_root']}\ndry_run={str(done['dry_run']).lower()}")
            for name in done["removed"]:
                print(f"{'would remove' if a.dry_run else 'removed'} {name}")
            for name in done["skipped"]:
                print(f"skipped {name}", file=sys.stderr)
        elif a.command == "serve":
            from .api import Engine
            from .server import Server
            from .sources.folded import Limits

            Server(Engine(_spark(), here, a.cache_capacity, Limits(file_bytes=most))).serve(sys.stdin, sys.stdout)
        else:
            from .api import Engine
            from .operators.paths import FrameWindow
            from .sources.folded import Limits

            given = json.loads(a.arguments)
            if w := given.get("frame_window"):
                given["frame_window"] = FrameWindow(**w)
            print(json.dumps(getattr(Engine(_spark(), here, a.cache_capacity, Limits(file_bytes=most)), a.tool)(**given), ensure_ascii=False))
    except ApiError as e:
        print(json.dumps(e.as_dict(), ensure_ascii=False), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
