import sys

from quiltrel.cli import main

sys.exit(main())
