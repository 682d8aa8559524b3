import sys

from veldt.cli import main

sys.exit(main())
