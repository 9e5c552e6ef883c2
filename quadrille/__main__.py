from quadrille.cli import main

raise SystemExit(main())
