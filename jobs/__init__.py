"""Jobs: work on whole tables that is run from the command line or as a registered query."""
