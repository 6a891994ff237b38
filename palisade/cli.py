"""``python -m palisade.cli validate PLAN --policy FILE --catalog FILE``: the response as JSON."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .plans.catalog import Catalog
from .plans.policy import PolicySet
from .plans.validate import validate


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palisade")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("validate", help="validate a plan against a policy set and a catalog")
    check.add_argument("plan", type=Path)
    check.add_argument("--policy", type=Path, required=True)
    check.add_argument("--catalog", type=Path, required=True)
    a = parser.parse_args(arguments)
    response = validate(json.loads(a.plan.read_text(encoding="utf-8")), PolicySet.load(a.policy), Catalog.load(a.catalog))
    print(json.dumps(response.plain(), indent=2, ensure_ascii=False, default=str))
    return 0 if response.status in ("ACCEPT", "REWRITE") else 2


if __name__ == "__main__":
    raise SystemExit(main())
