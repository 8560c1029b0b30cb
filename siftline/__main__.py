import sys

from siftline.cli import main

sys.exit(main())
