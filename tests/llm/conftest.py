import os
import sys

here = os.path.dirname(os.path.abspath(__file__))
for folder in (here, os.path.dirname(here), os.path.dirname(os.path.dirname(here))):
    if folder not in sys.path:
        sys.path.insert(0, folder)
