"""DataFrame operators. Each takes and returns DataFrames and triggers no action unless its docstring says so."""
