"""Reading of caption files into cues, and writing of cues into files."""
