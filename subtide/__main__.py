import sys

from subtide.cli import main

sys.exit(main())
