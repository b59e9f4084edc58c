import sys

from arcwright.cli import main

sys.exit(main())
