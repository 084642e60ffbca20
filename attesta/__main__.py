import sys

from attesta.cli import main

sys.exit(main(sys.argv[1:]))
