"""Entry file for ``spark-submit``; see ``python submit.py --help``."""

import sys

from lakehaul.cli import main

sys.exit(main())
