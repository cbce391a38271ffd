"""``python -m eventspark run pipeline.yaml [key=value ...]``, ``python -m eventspark stage NAME [key=value ...]`` and
``python -m eventspark stages``."""

from __future__ import annotations

import argparse

from eventspark.plans.pipeline import Pipeline, load_config, set_override
from eventspark.plans.registry import installed
from eventspark.session import get_session


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="eventspark", description=__doc__)
    sub = ap.add_subparsers(dest="what", required=True)
    for name, first, what in (("run", "config", "run a pipeline"), ("stage", "name", "run one stage")):
        run = sub.add_parser(name, help=what)
        run.add_argument(first)
        run.add_argument("overrides", nargs="*")
        run.add_argument("--overwrite", action="store_true")
        run.add_argument("--keep-intermediates", action="store_true")
    sub.add_parser("stages", help="list the stages")
    args = ap.parse_args(argv)
    registry = installed()
    if args.what == "stages":
        for name in sorted(registry):
            doc = (registry[name].fn.__doc__ or "").strip().splitlines()
            print(f"{name} ({registry[name].kind}): {doc[0] if doc else ''}")
        return 0
    if args.what == "stage":
        cfg: dict = {"stages": [args.name]}
        for o in args.overrides:
            own = o.split("=")[0].split(".")[0] not in ("input_dir", "output_dir", "code_modifiers", "float32_stats")
            set_override(cfg, f"stages.{args.name}.{o}" if own else o)
    else:
        cfg = load_config(args.config, args.overrides)
    for key in ("input_dir", "output_dir"):
        if not cfg.get(key):
            ap.error(f"the pipeline needs '{key}'")
    Pipeline.from_config(cfg, registry).run(get_session(), cfg["input_dir"], cfg["output_dir"], args.overwrite, args.keep_intermediates)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
