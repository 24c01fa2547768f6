"""python -m causeway run CONFIG.json | init CONFIG.json"""

import json
import sys


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in ("run", "init"):
        print(__doc__)
        return 2
    if args[0] == "init":
        with open(args[1], "w") as f:
            json.dump({"dataset": "cohort.parquet", "output": "out", "features": [{"name": "age", "kind": "continuous"}]}, f, indent=2)
        return 0
    from pyspark.sql import SparkSession

    from causeway.plans.experiment import ExperimentConfig, run

    with open(args[1]) as f:
        config = ExperimentConfig.from_dict(json.load(f))
    print(json.dumps(run(SparkSession.builder.getOrCreate(), config), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
