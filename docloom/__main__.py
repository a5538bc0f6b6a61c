"""`python -m docloom`: see docloom.cli."""

import sys

from docloom.cli import main

sys.exit(main())
