import sys

from glyphflow.plans.cli import main

sys.exit(main())
