"""Where the sample tables are (a module of its own: every folder has a conftest)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
