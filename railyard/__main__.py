import sys

from railyard.cli import main

sys.exit(main())
