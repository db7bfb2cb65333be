import sys

from portcullis.cli import main

sys.exit(main())
