import sys

from massif.cli import main

sys.exit(main())
