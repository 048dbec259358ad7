"""``python -m corvidex``."""

import sys

from .cli import main

sys.exit(main())
